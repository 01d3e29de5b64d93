"""Rows dealt into parts of bounded size that later passes meet again.

Operators that read a corpus several times exchange short packed messages between its parts and the keys they share:
every part tells each key range what it holds, and is told in return what the whole corpus holds there. The parts are
written once, bucketed by their number, so that grouping by part and joining messages to parts moves the messages
only, never the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sellerscope.session import staging_path

# Bytes of text in a part: bounds the memory of a task, not results. A longer text is a part of its own.
PART_BYTES = 16 << 20

Batches = Iterator[pa.RecordBatch]


def numbered(sizes: Callable[[pa.RecordBatch], np.ndarray], part_bytes: int = PART_BYTES) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` that puts a column ``part`` before the others, by the running sum of ``sizes``."""

    def run(batches: Batches) -> Batches:
        base, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = held + np.cumsum(sizes(batch), dtype=np.int64)
            if len(ends):
                held = int(ends[-1])
            part = pa.array(base + ends // part_bytes, pa.int64())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], ["part", *batch.schema.names])

    return run


def text_bytes(column: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Sizes by the bytes of a text column."""
    return lambda batch: pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)


def bucketed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the staging folder, bucketed and sorted by its column ``part``.

    A task writes a file for each of its parts, so nothing is shuffled. There are as many buckets as shuffle
    partitions; a task reads the parts of a bucket one after the other.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, "part").sortBy("part")
    writer.option("path", staging_path(spark, label)).saveAsTable(name)
    return spark.table(name)
