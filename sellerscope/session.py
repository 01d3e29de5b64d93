"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# Columns that tell rows of a stored table apart when all their values are equal.
ROW_KEYS = ["_file", "_row"]

_LOCAL_STAGING: dict[str, str] = {}


def build_session(app: str = "sellerscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one named in ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGING:
        _LOCAL_STAGING[app] = tempfile.mkdtemp(prefix="sellerscope-")
    return _LOCAL_STAGING[app]


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the staging folder."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage at points several later jobs start from. The files outlive executors, and the
    later jobs read only the columns they need.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.mode("error").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stage_with_row_keys(df: DataFrame, label: str) -> DataFrame:
    """``stage`` with the place of every row in the written files, which no retry can change."""
    return stage(df, label).select(
        "*",
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )


def side_by_side(work: dict[str, Callable[[], T]]) -> dict[str, T]:
    """Results of independent pieces of driver work, run at the same time.

    Jobs of one piece fill the gaps that another leaves on the cluster. The first error in the order of ``work`` is
    raised when all pieces have ended.
    """
    with ThreadPoolExecutor(max(len(work), 1)) as pool:
        running = {name: pool.submit(inheritable_thread_target(piece)) for name, piece in work.items()}
        return {name: future.result() for name, future in running.items()}
