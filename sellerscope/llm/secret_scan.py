"""Secrets in texts, and weak candidates linked to the parts that complete them.

Three kinds are reported wherever they stand: assignments to a name like password, access keys, long
hexadecimal runs. Three more are too weak alone: an assigned user name, a bare mixed token, an address
of a service. They are parts of a credential: identifiers (access, user), secrets (assign, hex, blob) and
endpoints. A weak part is reported only if its complements start within ``REACH`` characters in the same
document:

- a user name needs a secret, a bare token needs an identifier or an endpoint, an endpoint needs both an
  identifier and a secret.

The link is an interval join on starts. Places are dealt into cells of ``REACH`` characters; of each role a
cell keeps its first and last start, so a part meets three rows, its own cell's and the
neighbours', however many parts stand there.

All work is DataFrame expressions. Places are code points, ends exclusive: a text is split at the matches and
the lengths are summed. Rows are told apart by id and text.

Defined results: null and empty texts have no spans; repeated rows get the same spans each; rows without an
id are judged like others; an empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import bind

REACH = 200
MASK = "[secret]"
_CHUNK = 64

# The patterns and least lengths of the kinds that are always reported.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8

USER = r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
BLOB = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+"""

KINDS = ["assign", "access", "hex", "user", "blob", "endpoint"]
ROLES = {"identifier": ["access", "user"], "secret": ["assign", "hex", "blob"], "endpoint": ["endpoint"]}
_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"

Staged = Callable[[DataFrame, str], DataFrame]


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in chunks so that growing arrays stay short."""
    start = F.array(F.lit(0).cast("bigint"))

    def running(values: Column) -> Column:
        return F.aggregate(values, start, lambda a, x: F.array_append(a, F.get(a, F.size(a) - 1) + x))

    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    n_chunks = F.ceil(F.size(lengths) / F.lit(_CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))

    def of(parts: Column) -> Column:
        inside = F.transform(parts, lambda p: F.slice(running(p), F.lit(1), F.size(p)))
        bases = running(F.transform(parts, total))
        return bind(
            bases, lambda b: F.flatten(F.transform(inside, lambda p, i: F.transform(p, lambda x: x + F.get(b, i))))
        )

    return bind(chunks, of)


def spans(text: Column, pattern: str, kind: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Structs (start, rank, stop, kind) of the leftmost non-overlapping matches that are wanted."""
    none = F.array().cast(_SPAN)
    long = lambda s: F.length(s).cast("bigint")

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.transform(matches, lambda m, i: long(m) + long(F.get(gaps, i)))

        def span(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + long(F.get(gaps, i))
                return F.struct(
                    start.alias("start"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    (start + long(m)).alias("stop"),
                    F.lit(kind).alias("kind"),
                    m.alias("match"),
                )

            all_ = F.transform(matches, one)
            kept = F.filter(all_, lambda x: wanted(x["match"])) if wanted else all_
            return F.transform(kept, lambda x: F.struct(x["start"], x["rank"], x["stop"], x["kind"]))

        return bind(bind(steps, _sums_before), span).cast(_SPAN)

    def of(matches: Column) -> Column:
        found = bind(F.split(text, pattern), lambda gaps: placed(matches, gaps))
        return F.when(F.size(matches) > 0, found).otherwise(none)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def base_spans(text: Column) -> Column:
    """The spans that are always reported."""
    assigned = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED
    return F.concat(spans(text, ASSIGN, "assign", assigned), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def weak_spans(text: Column, base: Column) -> Column:
    """Candidates that count only with their complements; none overlaps a span of ``base``.

    What stands inside an endpoint is part of it: its path is no secret that it completes.
    """
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))

    def beside(ends: Column) -> Column:
        outside = lambda x: ~F.exists(ends, lambda e: (e["start"] <= x["start"]) & (x["stop"] <= e["stop"]))
        blobs = F.filter(spans(text, BLOB, "blob", mixed), outside)
        return F.filter(F.concat(spans(text, USER, "user"), blobs, ends), free)

    return bind(spans(text, ENDPOINT, "endpoint"), beside)


def _cells(parts: DataFrame) -> DataFrame:
    """By document and cell: which roles start in the cell, and where they start nearest in the cells beside it.

    A cell's first and last starts are shown to the cell itself and to both neighbours.
    """
    role = F.lit(None).cast("string")
    for name, kinds in ROLES.items():
        role = F.when(F.col("kind").isin(kinds), name).otherwise(role)
    keys = ["doc_id", "text_hash"]
    ends = parts.groupBy(*keys, "cell", role.alias("role")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    shown = ends.select(*keys, "cell", "role", "first", "last", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("to"))
    seen = lambda r, to: (F.col("role") == r) & (F.col("to") == to)
    columns = []
    for r in ROLES:
        columns += [
            F.coalesce(F.max(seen(r, 0)), F.lit(False)).alias(f"{r}_here"),
            F.max(F.when(seen(r, 1), F.col("last"))).alias(f"{r}_before"),
            F.min(F.when(seen(r, -1), F.col("first"))).alias(f"{r}_after"),
        ]
    return shown.groupBy(*keys, (F.col("cell") + F.col("to")).alias("cell")).agg(*columns)


def linked(candidates: DataFrame) -> DataFrame:
    """(doc_id, text_hash, linked): the weak spans that have their complements.

    ``candidates`` has (doc_id, text_hash, base, weak), one row for each document and text.
    """
    keys = ["doc_id", "text_hash"]
    parts = (
        candidates.filter(F.size("weak") > 0)
        .select(*keys, F.explode(F.concat("base", "weak")).alias("x"))
        .select(*keys, "x.*", F.floor(F.col("x.start") / F.lit(REACH)).alias("cell"))
    )
    weak = parts.filter(F.col("kind").isin(KINDS[3:]))
    cells = _cells(parts).withColumnsRenamed({c: f"of_{c}" for c in (*keys, "cell")})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.expr("text_hash = of_text_hash AND cell = of_cell")
    met = weak.join(cells, same)

    def near(role: str) -> Column:
        before = F.coalesce(F.col(f"{role}_before") >= F.col("start") - REACH, F.lit(False))
        after = F.coalesce(F.col(f"{role}_after") <= F.col("start") + REACH, F.lit(False))
        return F.col(f"{role}_here") | before | after

    complete = (
        F.when(F.col("kind") == "user", near("secret"))
        .when(F.col("kind") == "blob", near("identifier") | near("endpoint"))
        .otherwise(near("identifier") & near("secret"))
    )
    span = F.struct("start", "rank", "stop", "kind")
    return met.filter(complete).groupBy(*keys).agg(F.collect_list(span).alias("linked"))


def find_secrets(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans) of every row; arrays of (start, rank, stop, kind) by start, then kind."""
    text = F.coalesce(F.col(text_column), F.lit(""))

    def of(base: Column) -> Column:
        return F.struct(F.array_sort(base).alias("base"), weak_spans(text, base).alias("weak"))

    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_hash"), bind(base_spans(text), of).alias("x"))
    found = staged(rows.select("doc_id", "text_hash", "x.base", "x.weak"), "secret-parts")
    # one row for each document and text that has weak parts; repeated rows share it
    once = found.filter(F.size("weak") > 0).groupBy("doc_id", "text_hash").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    extra = linked(once).withColumnsRenamed({"doc_id": "of_doc_id", "text_hash": "of_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.expr("text_hash = of_text_hash")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    return found.join(extra, same, "left").select("doc_id", "text_hash", "base", every.alias("spans"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def masked(text: Column, found: Column) -> Column:
    """``text`` with every span, or run of spans that touch, replaced by ``MASK``; ``found`` is sorted by start."""

    def kept(x: Column, i: Column) -> Column:
        # the stretch from the furthest end so far to this span's start
        return F.substring(text, (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int"))

    grown = F.aggregate(
        found,
        F.struct(F.lit(0).cast("bigint").alias("stop"), F.array().cast("array<struct<from:bigint,start:bigint>>").alias("gaps")),
        lambda a, x: F.struct(
            F.greatest(a["stop"], x["stop"]).alias("stop"),
            F.when(
                (x["start"] > a["stop"]) | (F.size(a["gaps"]) == 0),
                F.array_append(a["gaps"], F.struct(a["stop"].alias("from"), x["start"].alias("start"))),
            )
            .otherwise(a["gaps"])
            .alias("gaps"),
        ),
    )

    def rebuilt(g: Column) -> Column:
        tail = F.substring(text, (g["stop"] + 1).cast("int"), F.length(text))
        return F.array_join(F.concat(F.transform(g["gaps"], kept), F.array(tail)), MASK)

    return F.when(F.size(found) > 0, bind(grown, rebuilt)).otherwise(text)


def mask_documents(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with secrets in their texts masked; all other columns stay as they are."""
    found = find_secrets(docs, staged, id_column, text_column).filter(F.size("spans") > 0)
    once = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first("spans").alias("_spans"))
    same = docs[id_column].eqNullSafe(once["_id"]) & (F.xxhash64(docs[text_column]) == once["_hash"])
    none = F.array().cast(_SPAN)
    text = F.when(once["_spans"].isNull(), docs[text_column]).otherwise(masked(docs[text_column], F.coalesce(once["_spans"], none)))
    return docs.join(once, same, "left").select(*[text.alias(c) if c == text_column else docs[c] for c in docs.columns])
