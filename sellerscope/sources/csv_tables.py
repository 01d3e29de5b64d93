"""CSV scan, catalog load and the temp views ad-hoc SQL runs on."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerscope.plans.views import order_core, seller_orders
from sellerscope.schema import SCHEMAS
from sellerscope.session import side_by_side
from sellerscope.sources import snapshots
from sellerscope.sources.quoted_lines import read_quoted_csv
from sellerscope.tables import Tables

# Free text may hold line breaks; such files are read by their bytes.
QUOTED_BREAKS = {"order_reviews"}


def read_csv_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan one CSV file (or folder) with header, matching columns by name.

    Declared columns get their type, a value that does not parse becomes missing, a declared column
    the file lacks is missing throughout. Undeclared columns are kept as text.
    """
    try:
        if table in QUOTED_BREAKS:
            text = read_quoted_csv(spark, path)
        else:
            text = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"missing source file for {table}: {path}") from error
        raise
    declared = SCHEMAS[table]
    typed = [
        (F.col(f.name).try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in declared
    ]
    extra = [F.col(c) for c in text.columns if c not in declared.names]
    return text.select(*typed, *extra)


def load_catalog(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    files: dict[str, str] | None = None,
    buckets: int | None = None,
) -> tuple[Tables, DataFrame]:
    """Replace all tables of the catalog at ``target_dir`` by their CSV files, at once, and register the views.

    ``files`` maps table to file name (``<table>.csv`` by default). The tables are a new snapshot, which becomes valid
    when all of them are written, side by side; a load that fails leaves the catalog as it was. Order, item, payment and review
    tables are bucketed by order (``buckets`` as in ``snapshots.write_table``). Returns the tables and a frame
    with one row per table: name, rows and columns loaded. Rows are counted by the write itself.
    """
    version, snapshot = snapshots.begin(spark, target_dir)

    def load_one(table: str) -> snapshots.StoredTable:
        frame = read_csv_table(spark, table, f"{source_dir}/{(files or {}).get(table, f'{table}.csv')}")
        return snapshots.write_table(frame, target_dir, snapshot, table, buckets)

    stored = list(side_by_side({table: partial(load_one, table) for table in SCHEMAS}).values())
    snapshots.commit(spark, target_dir, version, snapshot, stored)
    summary = [(t.name, t.n_rows, t.n_cols) for t in stored]
    return _opened(spark, target_dir, snapshot, stored), spark.createDataFrame(
        summary, "table_name string, n_rows bigint, n_cols int"
    )


def open_catalog(spark: SparkSession, target_dir: str) -> Tables:
    """Tables of the last ``load_catalog`` that ended, with the views registered again."""
    valid = snapshots.latest(spark, target_dir)
    if valid is None:
        raise FileNotFoundError(f"no catalog at {target_dir}: load one first")
    return _opened(spark, target_dir, valid["snapshot"], valid["tables"])


def _opened(spark: SparkSession, target_dir: str, snapshot: str, stored: list) -> Tables:
    tables = Tables(**{t.name: snapshots.open_table(spark, target_dir, snapshot, t) for t in stored})
    register_views(tables)
    return tables


def register_views(tables: Tables) -> None:
    """Temp views for ad-hoc SQL: the relations, ``v_order_core`` and ``v_seller_orders``."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    core = order_core(tables)
    core.createOrReplaceTempView("v_order_core")
    seller_orders(tables, core).createOrReplaceTempView("v_seller_orders")
