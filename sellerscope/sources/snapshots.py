"""Versions of a catalog: every load writes new folders, and one commit record makes them the valid ones.

A catalog folder holds ``snapshots/<version>-<id>/<table>`` and ``commits``. A record of ``commits`` names a snapshot,
its tables, their schemas, row counts and layout; it is written last, as one file that appears by a rename. Until
then readers see the former snapshot, and afterwards those that opened it keep it, since no load touches older
folders. A load that fails leaves a folder without a record. Old folders are left for the owner of the catalog to expire.

Tables with a key in ``BUCKET_KEYS`` are bucketed and sorted by it, so that grouping by the key, or joining two such
tables on it, moves no rows. A bucket is read by one task, so a table with a key of more rows than
``max(MAX_KEY_ROWS, rows / buckets)``, found by a frequent-items sketch, is laid out plainly: it is then shuffled when it
is joined, and adaptive execution can split the key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerscope.functions.joins import TRACKED

BUCKET_KEYS = {t: "order_id" for t in ("orders", "order_items", "order_payments", "order_reviews")}
MAX_KEY_ROWS = 1 << 20  # rows of one key that a bucket may hold whatever the number of rows

_CODEC = "zstd"  # a snapshot is written once and read often

_COMMIT = (
    "version bigint, snapshot string, "
    "tables array<struct<name string, columns string, n_rows bigint, n_cols int, key string, buckets int>>"
)


@dataclass(frozen=True)
class StoredTable:
    """A table of a snapshot; ``columns`` is its schema as JSON, ``buckets`` is 0 for a plain layout."""

    name: str
    columns: str
    n_rows: int
    n_cols: int
    key: str | None
    buckets: int


def key_sizes(frame: DataFrame, key: str) -> tuple[int, int]:
    """Rows of a table, and about how many of them the most frequent value of ``key`` has, missing ones included.

    Reads the key column once; the sketch has one row.
    """
    top = F.expr(f"approx_top_k(`{key}`, 1, {TRACKED})").alias("top")
    found = frame.agg(top, F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("missing")).first()
    return found["n"], max([found["missing"], *[x["count"] for x in found["top"]]])


def begin(spark: SparkSession, catalog: str) -> tuple[int, str]:
    """Number and folder of a new snapshot, unused so far."""
    last = latest(spark, catalog)
    version = last["version"] + 1 if last else 1
    return version, f"{version}-{uuid.uuid4().hex}"


def write_table(frame: DataFrame, catalog: str, snapshot: str, name: str, buckets: int | None = None) -> StoredTable:
    """Write one table of a snapshot; its rows are counted by the write itself.

    There are as many buckets as shuffle partitions unless said otherwise; 0 asks for a plain layout.
    """
    key, path = BUCKET_KEYS.get(name), f"{catalog}/snapshots/{snapshot}/{name}"
    if buckets is None:
        buckets = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if key is None or buckets < 1:
        key, buckets, empty = None, 0, frame.isEmpty()
    else:
        n, heaviest = key_sizes(frame, key)
        empty = n == 0
        if heaviest > max(MAX_KEY_ROWS, n / buckets):
            key, buckets = None, 0
    if empty:  # nothing is observed where the optimizer finds no rows
        frame.write.mode("error").parquet(path)
        return StoredTable(name, frame.schema.json(), 0, len(frame.columns), None, 0)
    written = Observation()
    counted = frame.observe(written, F.count(F.lit(1)).alias("n_rows"))
    if key is None:
        counted.write.mode("error").option("compression", _CODEC).parquet(path)
    else:
        # Partitioned as the buckets are, a task writes the one file of its bucket.
        dealt = counted.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
        dealt.mode("error").option("compression", _CODEC).option("path", path).saveAsTable(_registered(snapshot, name))
    return StoredTable(name, frame.schema.json(), written.get["n_rows"], len(frame.columns), key, buckets)


def commit(spark: SparkSession, catalog: str, version: int, snapshot: str, tables: list[StoredTable]) -> None:
    """Make a snapshot the valid one. Of two loads that began at the same version, the greater name is valid."""
    record = (version, snapshot, [Row(**vars(t)) for t in tables])
    spark.createDataFrame([record], _COMMIT).coalesce(1).write.mode("append").json(f"{catalog}/commits")


def latest(spark: SparkSession, catalog: str) -> Row | None:
    """The record of the valid snapshot; nothing where no load has ended."""
    try:
        records = spark.read.schema(_COMMIT).json(f"{catalog}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return records.orderBy(F.desc("version"), F.desc("snapshot")).first()


def open_table(spark: SparkSession, catalog: str, snapshot: str, stored: StoredTable | Row) -> DataFrame:
    """A table of a snapshot. A bucketed one gets a catalog entry of the session, which holds its layout."""
    path = f"{catalog}/snapshots/{snapshot}/{stored.name}"
    schema = T.StructType.fromJson(json.loads(stored.columns))
    if not stored.buckets:
        return spark.read.schema(schema).parquet(path)
    name = _registered(snapshot, stored.name)
    if not spark.catalog.tableExists(name):
        quoted = lambda x: "`" + x.replace("`", "``") + "`"
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(stored.key)}) "
            f"SORTED BY ({quoted(stored.key)}) INTO {stored.buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def _registered(snapshot: str, table: str) -> str:
    return f"catalog_{snapshot.replace('-', '_')}_{table}"
