"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of every ``PICK`` consecutive k-grams (``GRAM`` words each) the one of the
smallest hash is a fingerprint. A shared span of ``GRAM + PICK - 1`` words holds ``PICK``
k-grams that are the same on both sides, so the same one is picked: every shared window of ``WINDOW`` words has
a fingerprint in common. Documents' fingerprints are joined with those of the benchmark; each hit is
extended to the windows around it, and those are compared word for word with the benchmark's windows.
Items shorter than a window are one window as they are; their k-grams are that long and none is left
out.

Only (fingerprint, place) rows of documents meet the benchmark, and only places that hit carry words into
the second join. Benchmark tables are broadcast by Spark if their stored size is below its threshold,
else both sides are shuffled on hashes, and adaptive execution splits a frequent hash, of which the
benchmark side has one row.

Defined results: null or empty texts have no words, no hits and no items; items without words match
nothing; items without an id count for hit words and not in the lists of items; equal items are listed each; repeated
documents are judged one by one; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import bind

WINDOW = 10
GRAM = 5
PICK = WINDOW - GRAM + 1

# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Characters beyond ASCII that lower-casing is certain to leave alone.
_UNCASED = r"^[\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Z}\p{M}]*$"

Staged = Callable[[DataFrame, str], DataFrame]


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(_UNCASED), F.lower(text)).otherwise(slow)


def words(text: Column) -> Column:
    """The lower-cased words of a text; empty for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def grams(tokens: Column, size: int) -> Column:
    """The hash of every ``size`` consecutive words, by start."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (size - 1))
    none = F.array().cast("array<bigint>")
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size)))
    return F.when(F.size(tokens) >= size, hashes).otherwise(none)


def winnowed(hashes: Column) -> Column:
    """Structs (h, at): the smallest of every ``PICK`` consecutive hashes and a 0-based place of it.

    The lowest three bits of a hash give way to its place modulo 8, so a minimum tells where it was; 61
    bits are compared. Equal hashes in one window are the same gram, whichever of them is picked.
    """
    least = lambda a, gap: bind(
        F.size(a) - gap, lambda n: F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), lambda x, y: F.least(x, y))
    )
    placed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~7)).bitwiseOR(i.bitwiseAND(F.lit(7)).cast("bigint")))

    def spread(mins: Column, width: int) -> Column:
        """Minima of ``PICK`` values from minima of ``width``."""
        if width == PICK:
            return mins
        step = min(width, PICK - width)
        return bind(least(mins, step), lambda m: spread(m, width + step))

    def distinct(mins: Column) -> Column:
        new = F.filter(
            F.transform(mins, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
            lambda x: (x["i"] == 0) | (x["v"] != F.get(mins, x["i"] - 1)),
        )
        place = lambda x: x["i"] + (x["v"].bitwiseAND(F.lit(7)).cast("int") - x["i"]).bitwiseAND(F.lit(7))
        return F.transform(new, lambda x: F.struct(F.shiftright(x["v"], 3).alias("h"), place(x).alias("at")))

    none = F.array().cast("array<struct<h:bigint,at:int>>")
    found = bind(bind(placed, lambda v: spread(v, 1)), distinct)
    return F.when(F.size(hashes) >= PICK, found).otherwise(none)


def _short_sizes(items: DataFrame) -> list[int]:
    """Word counts below a window that occur among the items: at most ``WINDOW`` - 1 numbers."""
    found = items.filter(f"n > 0 AND n < {WINDOW}").select("n").distinct().collect()
    return sorted(r["n"] for r in found)


def fingerprints(tokens: Column, short_sizes: list[int]) -> Column:
    """Structs (size, h, at): winnowed grams, and all grams of the short sizes under their size."""
    tagged = lambda found, size: F.transform(
        found, lambda x: F.struct(F.lit(size).alias("size"), x["h"].alias("h"), x["at"].alias("at"))
    )
    every = lambda hashes: F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    parts = [tagged(bind(grams(tokens, GRAM), winnowed), WINDOW)]
    parts += [tagged(every(grams(tokens, m)), m) for m in short_sizes]
    return F.concat(*parts)


def item_windows(items: DataFrame) -> DataFrame:
    """(size, window, items): every window of the benchmark with the ids of the items that hold it."""
    n = F.size("tokens")
    size = F.least(n, F.lit(WINDOW))
    text = F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice("tokens", i, size), " ")
    )
    rows = items.filter(n > 0).select("item_id", size.alias("size"), F.explode(F.array_distinct(text)).alias("window"))
    return rows.groupBy("size", "window").agg(F.collect_set("item_id").alias("items"))


def item_fingerprints(items: DataFrame, short_sizes: list[int]) -> DataFrame:
    """The distinct (size, h) of the benchmark; an item gives the grams of its own size only."""
    own = F.least(F.size("tokens"), F.lit(WINDOW))
    found = F.filter(fingerprints(F.col("tokens"), short_sizes), lambda x: x["size"] == own)
    return items.select(F.explode(found).alias("x")).select("x.size", "x.h").distinct()


def _around(tokens: Column, size: Column, at: Column) -> Column:
    """Structs (start, window) of all windows of ``size`` words that hold the gram at ``at``."""
    long = size == WINDOW
    first = F.when(long, F.greatest(at - (WINDOW - GRAM), F.lit(0))).otherwise(at)
    last = F.when(long, F.least(at, F.size(tokens) - WINDOW)).otherwise(at)
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(tokens, i + 1, size), " ").alias("window"))
    )


def _hits(prints: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, places): where fingerprints of a document are among the benchmark's."""
    rows = prints.select("doc_id", "text_hash", F.explode("prints").alias("x"))
    hit = rows.select("doc_id", "text_hash", "x.size", "x.h", "x.at").join(found, ["size", "h"])
    return hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("size", "at")).alias("places"))


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans (start, size), given in order of start."""

    def step(a: Column, x: Column) -> Column:
        stop = x["start"] + x["size"]
        return F.struct(
            (a["n"] + F.greatest(stop - F.greatest(x["start"], a["stop"]), F.lit(0))).alias("n"),
            F.greatest(stop, a["stop"]).alias("stop"),
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    return F.aggregate(spans, zero, step, lambda a: a["n"].cast("long"))


def judge_documents(docs: DataFrame, benchmark: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) of every row of ``docs``; ``benchmark`` has (item_id, text).

    ``spans`` are the windows found, (start, size) in words. Rows are told apart by id and text.
    """
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    items = staged(benchmark.select("item_id", words(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens")), "items")
    short = _short_sizes(items)
    own_prints = staged(item_fingerprints(items, short), "item-prints")
    windows = staged(item_windows(items), "item-windows")
    of = lambda t: F.struct(F.size(t).cast("long").alias("n"), fingerprints(t, short).alias("prints"))
    prints = staged(
        rows.select("doc_id", "text_hash", bind(words(F.col("text")), of).alias("x")).select(
            "doc_id", "text_hash", F.col("x.n").alias("n_words"), "x.prints"
        ),
        "doc-prints",
    )
    keys = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    hits = _hits(prints, own_prints)
    near = rows.join(hits, keys(rows, hits)).select(rows["doc_id"], rows["text_hash"], "text", "places")

    def around(tokens: Column) -> Column:
        each = lambda p: F.transform(
            _around(tokens, p["size"], p["at"]),
            lambda w: F.struct(p["size"].alias("size"), w["start"].alias("start"), w["window"].alias("window")),
        )
        return F.array_distinct(F.flatten(F.transform(F.col("places"), each)))

    maybe = near.select("doc_id", "text_hash", F.explode(bind(words(F.col("text")), around)).alias("x"))
    sure = maybe.select("doc_id", "text_hash", "x.size", "x.start", "x.window").join(windows, ["size", "window"])
    judged = sure.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    judged = judged.withColumn("n_hit", _covered(F.col("spans")))
    slim = prints.select("doc_id", "text_hash", "n_words")
    none = F.array()
    return slim.join(judged, keys(slim, judged), "left").select(
        slim["doc_id"],
        slim["text_hash"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none.cast(judged.schema["items"].dataType)).alias("items"),
        F.coalesce("spans", none.cast(judged.schema["spans"].dataType)).alias("spans"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    bad = judge_documents(docs, benchmark, staged, id_column, text_column).filter("n_hit > 0")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = docs[id_column].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_column]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")
