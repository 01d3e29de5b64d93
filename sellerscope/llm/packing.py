"""Packing documents into token sequences by exact-complement hashing, then best fit.

Whole texts are encoded and ended with an id; texts of more than ``capacity`` tokens are cut into full
pieces behind one shorter first piece. What packing has to decide depends on the lengths alone, and
there are at most ``capacity`` of them. So the plan is made from a histogram of lengths: a list of
patterns, each a few lengths and how many sequences are filled that way. Its size depends on
``capacity``, not on the number of documents, and it is the only thing on the driver.

- Exact fill: from the longest length down, the gap of a piece is looked up among the single lengths, then the
  sums of two and of three; a combination is taken as often as its lengths are available.
- Best fit: the rest goes, longest first, into the open sequence whose room is left smallest.

Pieces then find their place by rank: the k-th piece of a length takes the k-th slot of that length. Ranks
are counts inside a partition plus the counts of the partitions before, so no task sees all pieces
of one length.

Null and empty texts are the end id alone. Repeated rows and rows without an id are packed like others. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerscope.llm.encoding import encoder

CAPACITY = 1024
END_ID = 2

Pattern = tuple[tuple[int, ...], int]


def _cut(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            at, rows, held = [], [], []
            for i, ids in encode(batch.column(1).to_pylist(), end_id):
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                begin, stop, piece = 0, len(ids) % capacity or capacity, 0
                while begin < len(ids):
                    n = stop - begin
                    rows.append((piece, begin, n, zlib.crc32(raw[4 * begin : 4 * stop]), part, seen[n]))
                    at.append(i)
                    if with_ids:
                        held.append(ids[begin:stop])
                    seen[n] += 1
                    begin, stop, piece = stop, stop + capacity, piece + 1
            if not rows:
                continue
            keys = batch.column(0).take(pa.array(at))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                ends = np.cumsum([0, *(len(x) for x in held)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([keys, *columns], names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text, with their rank among equal lengths of the partition.

    The result must be written before it is used twice: ``part`` and ``rank`` name rows of one run.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    return rows.mapInArrow(_cut(vocabulary, capacity, end_id, with_ids), schema + ", ids array<int>" * with_ids)


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def pair(self, total: int, low: int = 1) -> tuple[int, int] | None:
        """Two available lengths with this sum, the larger as large as can be and the smaller at least ``low``."""
        small = np.arange(low, total // 2 + 1)
        there = (self.left[small] > 0) & (self.left[total - small] > 0)
        if total % 2 == 0 and small.size:
            there[-1] &= self.left[total // 2] > 1
        hit = np.flatnonzero(there)
        return (total - int(small[hit[0]]), int(small[hit[0]])) if hit.size else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.left[gap] > 0:
            return (gap,)
        if hit := self.pair(gap):
            return hit
        for first in np.flatnonzero(self.left[1 : gap - 1])[::-1] + 1:
            self.left[first] -= 1
            hit = self.pair(gap - int(first))
            self.left[first] += 1
            if hit:
                return (int(first), *hit)
        return None


def packing_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns and how often each is used, that place every piece of a histogram of lengths."""
    lengths, plan = _Lengths(counts, capacity), []
    left = lengths.left
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for longest in range(capacity - 1, 0, -1):
        while left[longest] > 0:
            left[longest] -= 1
            rest = lengths.fill(capacity - longest)
            left[longest] += 1
            if rest is None:
                break
            pattern = (longest, *rest)
            times = min(int(left[x]) // pattern.count(x) for x in pattern)
            for x in pattern:
                left[x] -= times
            plan.append((pattern, times))
    open_: dict[int, list[Pattern]] = {}
    for length in range(capacity - 1, 0, -1):
        need = int(left[length])
        while need:
            room = next((r for r in range(length, capacity) if open_.get(r)), None)
            pattern, there = ((), need) if room is None else open_[room].pop()
            copies = min(need, (capacity if room is None else room) // length)
            times = min(there, need // copies)
            if room is not None and times < there:
                open_[room].append((pattern, there - times))
            made = pattern + (length,) * copies
            open_.setdefault(capacity - sum(made), []).append((made, times))
            need -= times * copies
    return plan + [p for same in open_.values() for p in same]


def _placed(plan: list[Pattern]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sequence and offset of a piece from its length and its rank among all pieces of that length."""
    slots, taken, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            slots.append((length, rank, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first = np.unique(table[:, 0], return_index=True)
        stop = np.append(first[1:], len(table))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                k, mask = np.searchsorted(lengths, value), length == value
                part = table[first[k] : stop[k]]
                row[mask] = first[k] + np.searchsorted(part[:, 1], rank[mask], side="right") - 1
            columns = [*batch.columns[:-1], pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece; ``pieces`` is a stored result of ``token_pieces``.

    On the driver: one count for each length, at most ``capacity`` of them.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        *[c for c in pieces.columns if c not in ("part", "rank")], (F.col("base") + F.col("rank")).alias("rank")
    )
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(_placed(packing_plan(counts, capacity)), ", ".join([*kept, "sequence_id bigint", "offset bigint"]))


def sequences(placed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from placed pieces that carry ``ids``; one sequence is at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
