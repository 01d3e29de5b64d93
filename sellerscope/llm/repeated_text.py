"""Removal of long repeated strings.

A byte is removed if it lies in a string of ``LENGTH`` bytes that starts at another place as well, in the same document or
another. Only places that may repeat are compared:

1. Every string of that length has an anchor (see ``anchors``); strings of one anchor start next to each other and
   form a stretch. Stretches are counted by the hash of their anchor. An anchor that occurs once repeats nothing.
2. Equal stretches of an anchor repeat as a whole, whoever else has the anchor.
3. Different stretches of one anchor may share a part: where a copied passage starts or ends. One of each
   goes, with its bytes, to the tasks by anchor. A task builds a run-length BWT index of its stretches, a bounded
   number of bytes at a time, streams the longest matches, and marks those of ``LENGTH`` bytes and more. Anchors of more than
   ``MAX_STRETCHES`` different stretches are not put into one index: their strings are counted by hash instead,
   which gives the same marks.

Counts are combined before they move, so a passage in a third of all documents is a row for each partition.

Hashes are of 64 bits; a stretch is taken for another only if the hashes of its anchor and of its bytes agree.

Defined results: null and empty texts have no bytes; matches do not cross documents; repeated rows repeat each
other, so all their strings of that length go, in both; rows without an id take part like others. An empty table gives
no rows. Extra columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerscope.llm.anchors import LENGTH, PART_BYTES, Rolling, anchors
from sellerscope.llm.run_length_index import longest_elsewhere

MAX_STRETCHES = 4096
INDEX_BYTES = 1 << 20

Staged = Callable[[DataFrame, str], DataFrame]
Batches = Iterator[pa.RecordBatch]


def _parts(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text, overlapping so that every string starts in exactly one."""
    for at in range(0, max(len(data) - LENGTH + 1, 0), PART_BYTES):
        yield at, np.frombuffer(data, np.uint8, min(PART_BYTES + LENGTH - 1, len(data) - at), at)


def _stretches(batches: Batches) -> Batches:
    """(doc_id, text_hash, anchor, stretch, first, more): strings start at first .. first + more."""
    names = ["doc_id", "text_hash", "anchor", "stretch", "first", "more"]
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        rows, found = [], [[np.zeros(0, k)] for k in (np.uint64, np.uint64, np.int32, np.int32)]
        for i, text in enumerate(batch.column(2)):
            for at, data in _parts(text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b""):
                rolling = Rolling(data)
                place, gram, first, last = anchors(rolling, len(data))
                shape = ((last - first) * 4096 + place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                stretch = rolling.of(first, last + LENGTH) ^ shape
                for out, a in zip(found, (gram, stretch, first + at, last - first), strict=True):
                    out.append(a.astype(out[0].dtype, copy=False))
                rows.append(np.full(len(place), i))
        if rows:
            at = pa.array(np.concatenate(rows))
            columns = [np.concatenate(a) for a in found]
            columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)


def _with_bytes(batches: Batches) -> Batches:
    """The bytes of each listed stretch of a text."""
    names = ["doc_id", "text_hash", "anchor", "first", "bytes"]
    for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        rows, held = [], []
        for i, (text, listed) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            for x in listed:
                rows.append(i)
                held.append((x["anchor"], x["first"], data[x["first"] : x["first"] + x["more"] + LENGTH]))
        if rows:
            at = pa.array(rows)
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)


def _marks(columns: list[pa.Array], rows: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Marks for strings that repeat, runs of neighbouring starts of a row as one."""
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1)]) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
    at = pa.array(rows[first], pa.int64())
    spans = [pa.array(start[first].astype(np.int32)), pa.array((start[last] + LENGTH).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in columns), *spans], ["doc_id", "text_hash", "start", "stop"])


def _indexed(batches: Batches) -> Batches:
    """Marks of the strings that different stretches of an anchor share; rows come in order of anchor."""

    def marked(held: pa.Table) -> pa.RecordBatch:
        strings = held["bytes"].to_pylist()
        starts, best = longest_elsewhere(strings)
        sizes = np.array([len(s) - LENGTH + 1 for s in strings])
        rows = np.repeat(np.arange(len(strings)), sizes)
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hit = best[starts[rows] + offset] >= LENGTH
        first = held["first"].to_numpy()
        columns = [held[c].combine_chunks() for c in ("doc_id", "text_hash")]
        return _marks(columns, rows[hit], first[rows[hit]] + offset[hit])

    held: list[pa.RecordBatch] = []
    size = 0
    last = None
    for batch in batches:
        anchor = batch.column(2).to_numpy()
        lengths = pa.compute.binary_length(batch.column(4)).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]]) if len(anchor) else [0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # whole anchors only: an index is closed where the anchor changes
            if size >= INDEX_BYTES and anchor[a] != last:
                yield marked(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(lengths[a:b].sum())
            last = anchor[a]
    if held:
        yield marked(pa.Table.from_batches(held))


def _strings(batches: Batches) -> Batches:
    """(doc_id, text_hash, anchor, string, start) of every string of the stretches."""
    for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        first = batch.column(3).to_numpy()
        rows, hashes, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, data in enumerate(batch.column(4).to_pylist()):
            at = np.arange(len(data) - LENGTH + 1)
            hashes.append(Rolling(np.frombuffer(data, np.uint8)).of(at, at + LENGTH))
            starts.append(first[i] + at)
            rows.append(np.full(len(at), i))
        at = pa.array(np.concatenate(rows))
        columns = [batch.column(i).take(at) for i in range(3)]
        columns += [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(starts).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "anchor", "string", "start"])


def _cut(batches: Batches) -> Batches:
    """Bytes, removed bytes and runs, hash of what is kept, and the runs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        out = []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            runs: list[dict[str, int]] = []
            for m in marks or ():
                if runs and m["start"] <= runs[-1]["stop"]:
                    runs[-1]["stop"] = max(runs[-1]["stop"], m["stop"])
                else:
                    runs.append(m)
            kept, at = hashlib.sha256(), 0
            for r in runs:
                kept.update(data[at : r["start"]])
                at = r["stop"]
            kept.update(data[at:])
            out.append((len(data), sum(r["stop"] - r["start"] for r in runs), len(runs), kept.hexdigest(), runs))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)


def remove_repeats(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are byte ranges that go."""
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = f"doc_id {kind}, text_hash bigint"
    found = rows.mapInArrow(_stretches, f"{keys}, anchor bigint, stretch bigint, first int, more int")
    repeated = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
    repeated = repeated.filter("n > 1").select("anchor", F.expr("lo <> hi").alias("mixed"))
    shared = staged(found.join(repeated, "anchor"), "shared-anchors")
    whole = ["doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("more") + LENGTH).alias("stop")]
    equal = shared.filter("NOT mixed").select(*whole)

    mixed = shared.filter("mixed")
    one = F.min(F.struct("doc_id", "text_hash", "first", "more")).alias("one")
    kinds = staged(mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), one), "stretches")
    again = mixed.join(kinds.filter("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select(*whole)
    by_text = kinds.select("one.doc_id", "one.text_hash", F.struct("anchor", "one.first", "one.more").alias("x"))
    by_text = by_text.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_list("x").alias("listed"))
    once = rows.join(by_text, F.expr("doc_id <=> of_id AND text_hash = of_hash AND text IS NOT NULL")).select("doc_id", "text_hash", "text", "listed")
    bytes_ = staged(once.mapInArrow(_with_bytes, f"{keys}, anchor bigint, first int, bytes binary"), "stretch-bytes")
    large = staged(kinds.groupBy("anchor").count().filter(F.col("count") > MAX_STRETCHES).select("anchor"), "large-anchors")
    marks = f"{keys}, start int, stop int"
    small = bytes_.join(large, "anchor", "left_anti").select("doc_id", "text_hash", "anchor", "first", "bytes")
    partly = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_indexed, marks)
    strings = (
        bytes_.join(large, "anchor")
        .select("doc_id", "text_hash", "anchor", "first", "bytes")
        .mapInArrow(_strings, f"{keys}, anchor bigint, string bigint, start int")
    )
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    counted = strings.join(twice, ["anchor", "string"]).select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("stop"))

    every = equal.union(again).union(partly).union(counted)
    spans = F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("marks")
    of = every.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(spans)
    marked = rows.join(of, F.expr("doc_id <=> of_id AND text_hash = of_hash"), "left").select("doc_id", "text", "marks")
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    return marked.mapInArrow(_cut, out)
