"""Token ids as ORC files in ascending document order.

Documents are dealt to ranges of ids before they are encoded, so text moves once and ids never. Each
range is sorted and written as ORC: integers are run-length coded in stripes, every stripe carries row
indexes, and ids of documents get Bloom filters, so a reader of one document skips files by their
statistics, stripes by the row index and row groups by the filter. Files are read stripe by stripe in
parallel.

``start`` is the number of ids in all documents before a document. It is a sum inside each file of
the rows before, plus the total of the files before; only a row of counts for each document is moved for it.

Null and empty texts give the end id alone. Rows of equal document id stay next to each other and are told
apart by their text; rows without an id come first. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sellerscope.llm.encoding import encoder

END_ID = 0
ROW_INDEX_STRIDE = 1_000
FALSE_POSITIVES = 0.01
STRIPE_BYTES = 16 << 20


def _encoded(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            keys, held, first, size = batch.column(0), [], 0, 0
            names = [batch.schema.names[0], "ids"]

            def out(keys: pa.Array, held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
                ends = np.cumsum([0, *(len(x) for x in held)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                return pa.RecordBatch.from_arrays([keys, ids], names)

            for i, ids in encode(batch.column(1).to_pylist(), end_id):
                held.append(ids)
                size += len(ids)
                if size >= 1 << 20:
                    yield out(keys[first : i + 1], held, names)
                    held, first, size = [], i + 1, 0
            if held:
                yield out(keys[first:], held, names)

    return run


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text, put ``end_id`` behind it and write (doc_id, ids) to ORC files below ``path``."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encoded(vocabulary, end_id), f"doc_id {kind}, ids array<int>")
        .write.mode("error")
        .option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of files written by ``write_token_files``; filters on doc_id reach the files."""
    return spark.read.orc(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and checksums of rows, numbered in the order in which the task reads them."""
    read = 0
    for batch in batches:
        ids = batch.column(1)
        ends = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())]
        at = pa.array(np.arange(read, read + batch.num_rows))
        read += batch.num_rows
        yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:], at], ["doc_id", "n_tokens", "ids_crc32", "file", "place", "at"])


def token_file_index(tokens: DataFrame, staged: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Start, count and checksum of every document's ids, from files as ``read_token_files`` gives them.

    Files follow one another by their smallest id. The files' order and
    the sums over the rows before in the file, by where the row's split begins and its place in the split, give every start. ``staged`` writes a table that is read twice.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    placed = tokens.select("doc_id", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"))
    counts = staged(
        placed.mapInArrow(_summed, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, file string, place bigint, at bigint"),
        "token-counts",
    )
    return with_starts(counts)


def with_starts(counts: DataFrame) -> DataFrame:
    """Running totals by document id, with no task over all rows.

    Documents are dealt by file; the files' totals, one row a file, get the running total of the files.
    """
    files = counts.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return inner.join(bases, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
