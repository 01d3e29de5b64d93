"""Parallel scan of CSV files whose quoted values hold line breaks.

A line break ends a record where the number of quotes before it is even. Files are read line by line in splits of any
size: one pass counts the quotes of each split, so the parity at every split's start is known; a task then cuts the
lines of its splits into records as they come, and the few records that cross a border are put together from their
pieces. The text itself is not shuffled, and no task holds more of it than a batch and a record.

Quotes in the files must be balanced (``"`` around a value, doubled inside it); an unquoted value holds none. Files
end their lines with ``\\n``, or all with ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sellerscope.session import stage

_SPLIT = ["_file", "_start"]
_OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}
_PIECES = "_file bigint, _start bigint, begun boolean, edge boolean, header boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its split and whether it has an odd number of quotes, in the order of the file."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))
    return text.select(
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
        (quotes % 2).alias("odd"),
    )


def _entered(lines: DataFrame) -> DataFrame:
    """A row for each split: whether a quoted value is open where it starts. One row for megabytes of text."""
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*_SPLIT).agg(F.sum("odd").alias("odd"))
    return splits.select(*_SPLIT, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("entered"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task's splits, as they come, cut into records.

    The last record of a split, and before the first one the rest of a record that an earlier split began, are edges.
    ``begun`` is false for such a rest. A record is held until the next one of its split begins.
    """
    split, inside, n_begun, held = None, 0, 0, []

    def rows(texts: list[str], edge: bool) -> pa.RecordBatch:
        """The next records of the split; the first of them may be the rest of an earlier one."""
        nonlocal n_begun
        begun = [n_begun + i > 0 for i in range(len(texts))]
        header = [split[1] == 0 and n_begun + i == 1 for i in range(len(texts))]
        n_begun += len(texts)
        columns = [[split[0]] * len(texts), [split[1]] * len(texts), begun, [edge] * len(texts), header, texts]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    def ended() -> list[pa.RecordBatch]:
        return [rows(["\n".join(held)], True)] if split and held else []

    for batch in batches:
        files, starts, odd = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_file", "_start", "odd"))
        entered = batch.column("entered").to_numpy(zero_copy_only=False)
        filled = pc.not_equal(batch.column("line"), "").to_numpy(zero_copy_only=False)
        borders = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
            if a == b:
                continue
            if split != (files[a], starts[a]):
                yield from ended()
                # Places are counted from the rest of an earlier record, which is there only if a value is open.
                split, inside, held = (int(files[a]), int(starts[a])), int(entered[a]), []
                n_begun = 1 - inside
            before = inside + np.cumsum(odd[a:b]) - odd[a:b]
            outside = before % 2 == 0
            inside = int((before[-1] + odd[b - 1]) % 2)
            kept = ~outside | filled[a:b]
            lines = batch.column("line").slice(a, b - a).filter(pa.array(kept)).to_pylist()
            firsts = np.flatnonzero(outside[kept])
            if not len(firsts):
                held += lines
                continue
            bounds = [0, *firsts.tolist()]
            done = ["\n".join([*held, *lines[: bounds[1]]])] if held or bounds[1] else []
            first_is_rest = bool(done) and n_begun == 0
            if first_is_rest:
                yield rows(done, True)
                done = []
            done += [lines[x] if y - x == 1 else "\n".join(lines[x:y]) for x, y in zip(bounds[1:], bounds[2:])]
            if done:
                yield rows(done, False)
            held = lines[bounds[-1] :]
    yield from ended()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each CSV record of a file or folder: its text, and whether it is its file's first (the header).

    Line breaks inside quotes are kept, as ``\\n``. Empty lines between records are no records. The splits' parities and
    the edges are stored, a row and two rows for a split, so that reading the records scans the text once.
    """
    lines = _lines(spark, path)
    entered = stage(_entered(lines), "csv-splits")
    # A broadcast join leaves the lines where and as they are.
    pieces = lines.join(F.broadcast(entered), _SPLIT).mapInArrow(_cut, _PIECES)
    edges = stage(pieces.filter("edge").drop("edge"), "csv-edges")
    so_far = Window.partitionBy("_file").orderBy("_start", "begun").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.array_sort(F.collect_list(F.struct("_start", "text")))
    joined = (
        edges.withColumn("record", F.count_if("begun").over(so_far))
        .groupBy("_file", "record")
        .agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.bool_or("header").alias("header"))
    )
    return pieces.filter("NOT edge").select("text", "header").unionByName(joined.select("text", "header"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV file or folder with a header in each file, as text.

    Equal to the ``multiLine`` reader, but a file is read by as many tasks as it has splits. An empty file gives no
    columns; names of repeated columns are those that the plain reader gives.
    """
    plain = spark.read.options(header=True, **_OPTIONS).csv(path)
    if not plain.columns:
        return plain
    values = F.from_csv("text", plain.schema.toDDL(), _OPTIONS)
    return csv_records(spark, path).filter("NOT header").select(values.alias("values")).select("values.*")
