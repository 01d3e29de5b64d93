from datetime import datetime
from pathlib import Path
from threading import Barrier
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerscope import session
from sellerscope.operators import features
from sellerscope.schema import METRICS_SCHEMA, SCHEMAS
from sellerscope.sources import artifacts, csv_tables, quoted_lines, snapshots


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_columns_are_matched_by_name_and_bad_values_are_missing(spark, tmp_path):
    path = write(
        tmp_path / "items.csv",
        "price,order_id,note,shipping_limit_date\n12.50,o1,kept,2018-01-02 03:04:05\nabc,o2,,not a date\n",
    )
    frame = csv_tables.read_csv_table(spark, "order_items", path)
    assert frame.schema["price"].dataType == T.DecimalType(12, 2)
    first, second = sorted(frame.collect(), key=lambda r: r["order_id"])
    assert float(first["price"]) == 12.5 and first["note"] == "kept"
    assert first["shipping_limit_date"] == datetime(2018, 1, 2, 3, 4, 5)
    assert second["price"] is None and second["shipping_limit_date"] is None
    assert first["seller_id"] is None


def test_review_texts_may_hold_quotes_commas_and_line_breaks(spark, tmp_path):
    path = write(
        tmp_path / "reviews.csv",
        'order_id,review_score,review_comment_message\no1,5,"bom, ""muito"" bom\nrecomendo"\no2,1,\n',
    )
    found = csv_tables.read_csv_table(spark, "order_reviews", path).orderBy("order_id").collect()
    assert found[0]["review_comment_message"] == 'bom, "muito" bom\nrecomendo'
    assert found[1]["review_comment_message"] is None and found[1]["review_score"] == 1


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("split_bytes", [16, 61, 4096])
def test_breaks_inside_quotes_across_splits(spark, tmp_path, ending, split_bytes):
    texts = ["plain", "", 'a "quoted" word', "two\nlines", "\n", 'ends in a quote"', '"\n"\n""', "x,\ny\n\nz", "é\n" * 40, "last"]
    folder = tmp_path / "reviews"
    folder.mkdir()
    for part in range(2):
        out = ["order_id,note,review_score"]
        for i, text in enumerate(texts * 3):
            quoted = text.replace('"', '""')
            out.append(f'{part}-{i},"{quoted}",{i % 5}' if i % 4 else f'{part}-{i},"{quoted}"')
            out += [""] * (i % 3 == 0)
        body = ending.join(line.replace("\n", ending) for line in out)
        (folder / f"{part}.csv").write_bytes((body + ending * part).encode())
    wanted = spark.read.options(header=True, escape='"', multiLine=True).csv(str(folder))
    wanted = sorted(wanted.collect(), key=lambda r: r["order_id"])
    assert len(wanted) == 60
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert split_bytes > 100 or quoted_lines._lines(spark, str(folder)).select("_file", "_start").distinct().count() > 20
        found = quoted_lines.read_quoted_csv(spark, str(folder))
        assert found.columns == ["order_id", "note", "review_score"]
        assert sorted(found.collect(), key=lambda r: r["order_id"]) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_are_cut_without_a_shuffle_of_the_text(spark, tmp_path):
    path = write(tmp_path / "reviews.csv", 'order_id,note\n' + 'o,"two\nlines"\n' * 50)
    records = quoted_lines.csv_records(spark, path)
    assert records.filter("NOT header").distinct().collect() == [('o,"two\nlines"', False)] and records.count() == 51
    tree = records._jdf.queryExecution().executedPlan().toString().splitlines()
    whole = [line for line in tree if line.lstrip().startswith(":")]  # the branch of records that cross no border
    assert any("MapInArrow" in line for line in whole) and not any("Exchange hashpartitioning" in line for line in whole)


def test_pieces_of_work_run_at_the_same_time_and_all_end():
    met, ended = Barrier(3, timeout=60), []

    def piece(name, error=None):
        met.wait()
        ended.append(name)
        if error:
            raise error
        return name

    with pytest.raises(FileNotFoundError):
        session.side_by_side({"a": lambda: piece("a"), "b": lambda: piece("b", FileNotFoundError()), "c": lambda: piece("c", ValueError())})
    assert sorted(ended) == ["a", "b", "c"]


def test_quoted_csv_of_nothing(spark, tmp_path):
    assert quoted_lines.read_quoted_csv(spark, write(tmp_path / "empty.csv", "")).count() == 0
    header = quoted_lines.read_quoted_csv(spark, write(tmp_path / "header.csv", "order_id,note\n"))
    assert header.columns == ["order_id", "note"] and header.count() == 0
    assert csv_tables.read_csv_table(spark, "order_reviews", str(tmp_path / "empty.csv")).count() == 0


def test_missing_file_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere.csv"):
        csv_tables.read_csv_table(spark, "orders", str(tmp_path / "nowhere.csv"))
    with pytest.raises(FileNotFoundError, match="nowhere.csv"):
        csv_tables.read_csv_table(spark, "order_reviews", str(tmp_path / "nowhere.csv"))


def test_catalog_load_and_open(spark, generated, tmp_path):
    for name, frame in generated.items():
        artifacts.write_csv(frame, str(tmp_path / "csv" / name))
    write(tmp_path / "csv" / "geolocation", "zip,lat\n1,2\n")
    files = {name: name for name in SCHEMAS}
    tables, report = csv_tables.load_catalog(spark, str(tmp_path / "csv"), str(tmp_path / "db"), files)
    counts = {r["table_name"]: r["n_rows"] for r in report.collect()}
    assert set(counts) == set(SCHEMAS)
    assert counts["orders"] == generated.orders.count() and counts["geolocation"] == 1
    assert spark.table("v_seller_orders").count() >= counts["order_items"]
    again = csv_tables.open_catalog(spark, str(tmp_path / "db"))
    assert again.orders.schema == tables.orders.schema
    assert dict(again.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert again.orders.filter("order_purchase_timestamp IS NULL").count() == 0


def exported(generated, folder):
    for name, frame in generated.items():
        artifacts.write_csv(frame, str(folder / name))
    write(folder / "geolocation", "zip,lat\n1,2\n")
    return str(folder), {name: name for name in SCHEMAS}


def exchanges(frame):
    """Shuffles of the plan, as the text of their partitioning."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_bucketed_tables_meet_without_a_shuffle(spark, generated, tmp_path):
    source, files = exported(generated, tmp_path / "csv")
    tables, _ = csv_tables.load_catalog(spark, source, str(tmp_path / "db"), files)
    inputs = features.order_inputs(tables)
    assert exchanges(features.order_inputs(generated)) and not [x for x in exchanges(inputs) if "(order_id" in x]
    plain, _ = csv_tables.load_catalog(spark, source, str(tmp_path / "plain"), files, buckets=0)
    assert [x for x in exchanges(features.order_inputs(plain)) if "(order_id" in x]
    digits = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in inputs.dtypes]
    found, wanted = inputs.select(*digits), features.order_inputs(plain).select(*digits)
    assert found.count() > 500 and found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    # a session that has no entry of the tables yet finds the layout in the commit record
    valid = snapshots.latest(spark, str(tmp_path / "db"))
    name = snapshots._registered(valid["snapshot"], "order_items")
    spark.sql(f"DROP TABLE {name}")
    again = csv_tables.open_catalog(spark, str(tmp_path / "db"))
    assert again.order_items.schema == tables.order_items.schema
    assert not [x for x in exchanges(features.order_inputs(again)) if "(order_id" in x]


def test_a_load_that_fails_leaves_the_catalog_as_it_was(spark, generated, tmp_path):
    source, files = exported(generated, tmp_path / "csv")
    target = str(tmp_path / "it's a db")
    with pytest.raises(FileNotFoundError, match="no catalog"):
        csv_tables.open_catalog(spark, target)
    before, _ = csv_tables.load_catalog(spark, source, target, files)
    n_items = before.order_items.count()
    write(tmp_path / "few.csv", "order_id,price\no1,2.50\n")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        csv_tables.load_catalog(spark, source, target, {**files, "order_items": "../few.csv", "sellers": "nowhere"})
    assert csv_tables.open_catalog(spark, target).order_items.count() == n_items
    csv_tables.load_catalog(spark, source, target, {**files, "order_items": "../few.csv"})
    assert csv_tables.open_catalog(spark, target).order_items.count() == 1
    assert before.order_items.count() == n_items  # a reader of the former snapshot keeps it


def test_a_table_with_a_hot_order_is_not_bucketed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_KEY_ROWS", 50)
    hot = F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string"))
    for name, key, buckets in [("hot", hot, 0), ("even", F.col("id").cast("string"), 4), ("none", F.lit(None).cast("string"), 0)]:
        frame = spark.range(1000).select(key.alias("order_id"), F.col("id").alias("n`1"))
        stored = snapshots.write_table(frame, str(tmp_path), f"1-{name}", "order_items", buckets=4)
        assert (stored.buckets, stored.n_rows) == (buckets, 1000)
        opened = snapshots.open_table(spark, str(tmp_path), f"1-{name}", stored)
        assert opened.agg(F.sum("`n``1`")).first()[0] == 499500
        assert bool(exchanges(opened.groupBy("order_id").count())) == (buckets == 0)


def test_bucketed_tables_of_nothing(spark, tmp_path):
    header = csv_tables.read_csv_table(spark, "order_items", write(tmp_path / "items.csv", "order_id,price\n"))
    for name, empty in [("local", spark.createDataFrame([], SCHEMAS["order_items"])), ("header", header)]:
        stored = snapshots.write_table(empty, str(tmp_path), f"1-{name}", "order_items")
        assert stored.n_rows == 0 and snapshots.open_table(spark, str(tmp_path), f"1-{name}", stored).count() == 0


def test_parquet_artifact_is_built_only_when_absent(spark, tmp_path):
    path, built = str(tmp_path / "art"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert artifacts.read_or_build(spark, path, build).count() == 3
    artifacts.write_parquet(spark.range(5), path)
    assert artifacts.read_or_build(spark, path, build).count() == 5
    assert len(built) == 1
    empty = artifacts.read_parquet_or_empty(spark, str(tmp_path / "no"), spark.range(1).schema)
    assert empty.count() == 0


def test_csv_results(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert artifacts.read_csv_or_empty(spark, path, METRICS_SCHEMA).count() == 0
    row = spark.createDataFrame([("a", 0.71, 0.5, 0.4, 0.9)], METRICS_SCHEMA)
    artifacts.write_csv(row, path)
    assert artifacts.read_csv_or_empty(spark, path, METRICS_SCHEMA).collect() == row.collect()


def test_staging_follows_the_cluster_setting(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.stage(spark.range(4), "x").count() == 4
    assert session.staging_root(spark) == shared and list(Path(shared).glob("x-*"))


def test_staging_needs_a_shared_folder_on_a_cluster():
    def named(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: default),
            sparkContext=SimpleNamespace(master=master, applicationId="app"),
        )

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.staging_root(named("spark://somewhere"))
    assert session.staging_root(named("local[2]")) == session.staging_root(named("local[2]"))


def test_compressed_copies_give_the_same_rows_from_less_space(spark, generated, tmp_path):
    sizes, found = [], []
    for codec in ("none", "gzip"):
        path = tmp_path / codec
        artifacts.write_csv(generated.order_items, str(path), codec)
        sizes.append(sum(f.stat().st_size for f in path.glob("part-*")))
        found.append(sorted(csv_tables.read_csv_table(spark, "order_items", str(path)).collect(), key=str))
    assert found[0] == found[1] and len(found[0]) == generated.order_items.count()
    assert sizes[1] < sizes[0] / 2
    assert session.stage(generated.orders, "small", "zstd").count() == generated.orders.count()
