"""Near duplicates by MinHash and a multi-index Hamming join.

A document's set holds its distinct shingles. Equal sets form a class, and a class is one node, named by its smallest
document id. A node's signature is ``CHUNKS`` chunks of ``CHUNK_VALUES`` MinHash values, each cut to ``VALUE_BITS`` bits.
Every chunk is indexed once for each value left out, so two chunks meet if at most one of their values
differs. Two signatures that differ in fewer than 2 x ``CHUNKS`` values have, by the pigeonhole, a chunk with at most
one error, so every such pair meets in a bucket. (At a similarity of 0.75 a value differs with
probability 1/4; all chunks have two errors or more with a probability of about 1e-7.)

Buckets are not expanded into pairs:

1. Each bucket pairs its members with a pivot; of those a member keeps the ``BEST_PIVOTS`` it shares most buckets with. Members carry a sketch of their signature and the class of their
   size, so most pairs that cannot be similar go at once; the others are confirmed on the full sets, and links are
   closed to components.
2. Buckets whose members now share a component are done. The others are compared in blocks of at most
   ``BLOCK`` by ``BLOCK`` members. Members bring their sets, or samples of longer ones, so that of the pairs of different
   components with close signatures only those leave a block, each from the first bucket it shares, that are similar
   (or, of longer sets, likely to be). A group of copies too unlike each other leaves none. What leaves is confirmed on the full sets.

The pigeonhole guarantees all pairs that differ in up to ``2 * CHUNKS - 1`` = 31 values. Pairs that differ in up to ``MAX_DIFFERENT`` are
kept where they meet; a similarity of 0.75 shares no bucket with a probability of 1e-7, and exceeds ``MAX_DIFFERENT`` values, or
``MAX_SKETCH_BITS`` bits of the sketch, with a probability below 1e-6.

Components are found by alternating large-star and small-star steps on stored edges. A node of many links, or a bucket of
many members, is met by joins that adaptive execution splits, never gathered in one place.

Defined results: null texts and texts without words have an empty set and are linked with nothing; repeated rows
form a class; rows that share an id are one node; rows without an id are judged, but neither link nor are linked, and
have no component. An empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SHINGLE = 5
PERCENT = 75
CHUNKS = 16
CHUNK_VALUES = 5
VALUE_BITS = 16
VALUES = CHUNKS * CHUNK_VALUES
MAX_DIFFERENT = 40
SKETCH_BITS = (58, 64)
MAX_SKETCH_BITS = 38
BEST_PIVOTS = 8
BLOCK = 512
SAMPLE = 256  # hashes of a set that go to its blocks: the whole set, if it is not longer
DEVIATIONS = 5.2
_SLOT_BITS = 7  # lowest bits of a bucket: which chunk and value it leaves out
_SIZE_BITS = 6  # lowest bits of a sketch: the class of the set's size
_SIZE_BASE = 1.34  # above 4/3, so similar sets are in the same or in neighbouring classes
_SET_BLOCK = 250_000  # shingles hashed at once
_WORDS_KEPT = 200_000  # hashes of words a worker remembers

Staged = Callable[[DataFrame, str], DataFrame]

_random = np.random.default_rng(75)
_FACTORS = _random.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_FACTORS = _random.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = _random.integers(0, 1 << 63, VALUES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of a word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, known: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; A-Z are lower-cased, words end at ASCII white space."""
    # on bytes, lower() changes A-Z only and split() knows the six ASCII white spaces only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > _WORDS_KEPT:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += _mixed(h[i : i + n] * _WORD_FACTORS[i])
    return np.unique(_mixed(total))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of cut MinHash values for each of the non-empty sets."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= _SET_BLOCK):
            held += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        at = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        for k in range(VALUES):
            least = np.minimum.reduceat(flat * _FACTORS[k], at)
            out[start:stop, k] = (least * _MIX) >> np.uint64(48)
        start = stop
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        sets = [shingle_set(t, known) for t in batch.column(1).to_pylist()]
        filled = [s for s in sets if len(s)]
        found = iter(_signatures(filled))
        signature = [next(found).tobytes() if len(s) else None for s in sets]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "signature"])


def _as_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _sketches(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit words of a signature's bits: the lowest of every value, then the next of the first values."""
    bits = np.concatenate([values & 1, (values >> 1) & 1], axis=1).astype(np.uint64)
    out, at = [], 0
    for n in SKETCH_BITS:
        word = np.zeros(len(values), np.uint64)
        for i in range(n):
            word |= bits[:, at + i] << np.uint64(64 - n + i)
        out.append(word)
        at += n
    out[0] |= (np.log(sizes) / np.log(_SIZE_BASE)).astype(np.uint64)
    return [w.view(np.int64) for w in out]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, sketch): one bucket for each chunk and value left out of it."""
    slots = np.arange(VALUES, dtype=np.uint64)
    for part in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
        signature = _as_matrix(part.column(2))
        values = signature.astype(np.uint64).reshape(-1, CHUNKS, CHUNK_VALUES)
        keys = np.zeros((len(values), CHUNKS, CHUNK_VALUES), np.uint64)
        for out in range(CHUNK_VALUES):
            for i, v in enumerate(v for v in range(CHUNK_VALUES) if v != out):
                keys[:, :, out] |= values[:, :, v] << np.uint64(VALUE_BITS * i)
        keys = _mixed(keys.reshape(len(values), VALUES) ^ _SLOTS) >> np.uint64(_SLOT_BITS) << np.uint64(_SLOT_BITS) | slots
        rows = np.repeat(np.arange(len(values)), VALUES)
        nodes = part.column(0).take(pa.array(rows))
        sketch = [pa.array(w[rows]) for w in _sketches(signature, part.column(1).to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), nodes, *sketch], ["bucket", "node", "s1", "s2"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    known, last, last_set = _Words(), None, None
    for batch in batches:
        keep = []
        texts_a, texts_b = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            a = texts_a[i].as_py()
            if a != last:
                last, last_set = a, shingle_set(a, known)
            b = shingle_set(texts_b[i].as_py(), known)
            shared = len(np.intersect1d(last_set, b, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(last_set) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _first_slot(other: np.ndarray) -> np.ndarray:
    """The first bucket that two signatures share, by where they differ."""
    parts = other.reshape(-1, CHUNKS, CHUNK_VALUES)
    errors = parts.sum(axis=2, keepdims=True)
    return ((errors == 0) | ((errors == 1) & parts)).reshape(-1, VALUES).argmax(axis=1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, sample): the high halves of the smallest hashes of a set, all of a set of up to ``SAMPLE``."""
    known = _Words()
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        sets = [shingle_set(t, known) for t in batch.column(1).to_pylist()]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        sample = [(s[:SAMPLE] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(sample, pa.binary())], ["node", "digest", "sample"])


class _Samples:
    """Samples of the sets of some members, and which members can be similar to a set.

    Two whole sets are compared exactly, but for halves of hashes that agree by chance, for which one is allowed. Of
    longer sets the part below the smaller of the two samples' ends is compared; a similarity of 0.75 falls ``DEVIATIONS``
    standard deviations short there with a probability below 1e-6.
    """

    def __init__(self, bodies: list[bytes], sizes: np.ndarray):
        self.of = [np.frombuffer(b, "<u4") for b in bodies]
        self.sizes = sizes
        self.whole = sizes <= SAMPLE
        self.ends = np.array([np.iinfo(np.uint32).max if w else s[-1] for s, w in zip(self.of, self.whole)], np.uint32)

    def similar(self, mine: int, other: _Samples, at: np.ndarray) -> np.ndarray:
        """Which of the members ``at`` of ``other`` may be similar to the member ``mine``."""
        a = self.of[mine]
        flat = np.concatenate([other.of[i] for i in at.tolist()])
        lengths = np.array([len(other.of[i]) for i in at.tolist()])
        end = np.minimum(other.ends[at], self.ends[mine])
        below = flat <= np.repeat(end, lengths)
        place = np.minimum(np.searchsorted(a, flat), len(a) - 1)
        first = np.cumsum(lengths) - lengths
        shared = np.add.reduceat((a[place] == flat) & below, first, dtype=np.int64)
        union = np.searchsorted(a, end, "right") + np.add.reduceat(below, first, dtype=np.int64) - shared
        exact = 100 * (shared + 1) >= PERCENT * (self.sizes[mine] + other.sizes[at] - shared - 1)
        share = PERCENT / 100
        likely = shared >= share * union - DEVIATIONS * np.sqrt(share * (1 - share) * union)
        return np.where(self.whole[mine] & other.whole[at], exact, likely)


def _close_pairs(group: pa.Table) -> list[tuple]:
    """Pairs of different components, left against right members of one block, that can be similar."""
    side = group["side"].to_numpy()
    slot = group["bucket"][0].as_py() & ((1 << _SLOT_BITS) - 1)
    members = []
    for k in (0, 1):
        rows = group.filter(pa.array(side == k))
        if not rows.num_rows:
            return []
        signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(-1, VALUES)
        sizes = rows["n_shingles"].to_numpy()
        node, component = (np.array(rows[c].to_pylist()) for c in ("node", "component"))
        members.append((signature, sizes, node, component, _Samples(rows["sample"].to_pylist(), sizes)))
    (a, size_a, node_a, comp_a, samples_a), (b, size_b, node_b, comp_b, samples_b) = members
    out = []
    for i in range(len(a)):
        near = (comp_b != comp_a[i]) & (node_b != node_a[i])
        near &= 100 * np.minimum(size_b, size_a[i]) >= PERCENT * np.maximum(size_b, size_a[i])
        at = np.flatnonzero(near)
        other = b[at] != a[i]
        at = at[(other.sum(axis=1) <= MAX_DIFFERENT) & (_first_slot(other) == slot)]
        if len(at):
            at = at[samples_a.similar(i, samples_b, at)]
            node = node_a[i].item()
            out += [(min(node, x), max(node, x)) for x in node_b[at].tolist()]
    return out


def _compared(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The close pairs of every block; rows come in order of block."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                now = tuple(key[:, x].tolist())
                if now != last and held:
                    yield pairs(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = now
        if held:
            yield pairs(held)

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _close_pairs(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], ["a", "b"])

    return run


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Large-star and small-star steps take turns until the edges stay as they are; each step is stored.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        met = both.join(least, F.col("a") == F.col("of"))
        if large:
            moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(now)
    while True:
        now = staged(star(star(now, large=True), large=False), "stars")
        found = state(now)
        if found == seen:
            break
        seen = found
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres).distinct()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _released(staged: Staged) -> Staged:
    """``staged`` that leaves no shuffle files behind: what it wrote outlives them, and later steps read that."""

    def run(df: DataFrame, label: str) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            return staged(df, label)
        finally:
            conf.set(_CLEANUP, before)

    return run


def _close(sizes: tuple[str, str]) -> Column:
    a, b = map(F.col, sizes)
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


class _Join:
    def __init__(self, docs: DataFrame, staged: Staged):
        staged = self.staged = _released(staged)
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {self.kind}, n_shingles bigint, digest binary, signature binary"
        self.docs = docs
        self.described = staged(docs.mapInArrow(_described, schema), "signatures")
        named = self.described.filter("doc_id IS NOT NULL AND n_shingles > 0")
        classes = named.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
        self.classes = staged(classes, "classes")

    def _sized(self, pairs: DataFrame) -> DataFrame:
        """Pairs of similar size whose signatures do not differ too much."""
        side = lambda x: self.classes.select(
            F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}")
        )
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(_close(("n_a", "n_b")))
        return met.mapInArrow(_near, f"a {self.kind}, b {self.kind}").distinct()

    def _links(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that are similar on their full sets, stored."""
        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
        return self.staged(met.mapInArrow(_confirmed, f"a {self.kind}, b {self.kind}").distinct(), "sure-pairs")

    def run(self) -> DataFrame:
        """(node, component) of every node that is linked."""
        schema = f"bucket bigint, node {self.kind}, s1 bigint, s2 bigint"
        members = self.classes.select("node", "n_shingles", "signature").mapInArrow(_indexed, schema)
        pivot = F.min_by(F.struct("node", "s1", "s2"), F.xxhash64("node")).alias("pivot")
        pivots = members.groupBy("bucket").agg(pivot, F.count("*").alias("n")).filter("n > 1")
        shared = self.staged(members.join(pivots, "bucket"), "buckets")
        size = lambda c: F.col(c).bitwiseAND(F.lit((1 << _SIZE_BITS) - 1))
        bits = F.bit_count(F.shiftright(F.col("s1").bitwiseXOR(F.col("pivot.s1")), _SIZE_BITS).bitwiseAND(F.lit((1 << SKETCH_BITS[0]) - 1)))
        bits += F.bit_count(F.col("s2").bitwiseXOR(F.col("pivot.s2")))
        near = shared.filter((F.abs(size("s1") - size("pivot.s1")) <= 1) & (bits <= MAX_SKETCH_BITS)).filter("node <> pivot.node")
        # a member of larger buckets keeps its best pivots, out of at most one a bucket; step 2 sees all their pairs
        counted = near.filter("n > 2").groupBy("node", F.col("pivot.node").alias("other")).agg(F.count("*").alias("n"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("n", "other")), asc=False), 1, BEST_PIVOTS)
        most = counted.groupBy("node").agg(best.alias("best")).select("node", F.explode("best").alias("x")).select("node", "x.other")
        both = near.filter("n = 2").select("node", F.col("pivot.node").alias("other")).union(most)
        pairs = both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        nodes = shared.select("node").distinct()
        texts = self.docs.join(nodes, F.col("doc_id") == F.col("node")).select("node", "text")
        texts = self.staged(texts.distinct(), "shared-texts")
        first = self._links(self._sized(pairs), texts)
        found = self.staged(components(first, self.staged), "components")
        rest = self._links(self._rest(shared.select("bucket", "node"), found, texts), texts)
        if rest.isEmpty():
            return found
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), self.staged)

    def _rest(self, shared: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
        """Close pairs of different components in the buckets that are not of one component yet."""
        placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        # a bucket of two has been compared already
        open_ = mixed.filter("lo <> hi AND n > 2").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        rows = self.staged(placed.join(open_, "bucket"), "open-buckets")
        own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
        rows = rows.withColumn("own", own).join(self.classes.select("node", "n_shingles", "digest", "signature"), "node")
        listed = texts.join(rows.select("node").distinct(), "node").select("node", "text")
        samples = self.staged(listed.mapInArrow(_sampled, f"node {self.kind}, digest binary, sample binary"), "set-samples")
        rows = rows.join(samples, ["node", "digest"])
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        left = F.transform(F.filter(others, lambda j: j >= F.col("own")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        right = F.transform(F.filter(others, lambda i: i <= F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
        dealt = rows.select("bucket", "node", "component", "n_shingles", "signature", "sample", F.explode(F.concat(left, right)).alias("x")).select("*", "x.*").drop("x")
        # work goes with the square of a block, so partitions are not to be joined by their bytes
        tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = dealt.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        kind = to_arrow_type(dealt.schema["node"].dataType)
        return self.staged(blocks.mapInArrow(_compared(kind), f"a {self.kind}, b {self.kind}").distinct(), "close-pairs")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_as_matrix(batch.column(batch.schema.get_field_index(c))) for c in ("s_a", "s_b"))
        keep = pa.array((a != b).sum(axis=1) <= MAX_DIFFERENT)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], ["a", "b"])


def near_duplicates(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    join = _Join(rows, staged)
    found = join.run()
    of = join.classes.select("n_shingles", "digest", "node").join(found, "node", "left")
    of = of.select(F.col("n_shingles").alias("of_n"), F.col("digest").alias("of_digest"), F.coalesce("component", "node").alias("component"))
    met = join.described.join(of, F.expr("doc_id IS NOT NULL AND n_shingles = of_n AND digest = of_digest"), "left")
    # ids that stand for several texts are one node: they take the smallest of its components
    component = F.coalesce("component", "doc_id")
    return met.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def first_of_each_group(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns; rows without an id stay."""
    found = near_duplicates(docs, staged, id_column, text_column)
    by_id = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kept_id"))
    kept = by_id.agg(F.count("*").alias("_n"), F.bool_or("kept").alias("_kept")).filter("_kept").drop("_kept")
    others = [c for c in docs.columns if c != id_column]
    named = docs.join(kept, docs[id_column] == kept["_kept_id"])
    # of rows that share the kept id, the first by text and then by the other columns as JSON
    shared = lambda c: F.when(F.col("_n") > 1, c)
    order = F.struct(shared(F.col(text_column)), shared(F.to_json(F.struct(F.lit(0), *[c for c in others if c != text_column]))))
    first = F.min_by(F.struct(*others), order).alias("_row")
    one = named.groupBy(id_column).agg(first).select(id_column, *[F.col("_row")[c].alias(c) for c in others])
    return one.select(*docs.columns).unionByName(docs.filter(docs[id_column].isNull()))
