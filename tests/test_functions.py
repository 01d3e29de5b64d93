import random
import statistics

import pytest
from pyspark.sql import functions as F

from sellerscope.functions import expressions as X
from sellerscope.functions import joins, ranks


@pytest.fixture
def narrow_rounds(monkeypatch):
    """Force the histogram rounds that large inputs go through."""
    monkeypatch.setattr(ranks, "MAX_LISTED_ROWS", 5)
    monkeypatch.setattr(ranks, "ACCURACY", 20)


def test_rounding(spark):
    frame = spark.createDataFrame([(1.025, 2.5), (-3.125, 3.5), (None, None)], "a double, b double")
    found = frame.select(
        X.round_sql(F.col("a"), 2).alias("a"), X.round_half_even(F.col("b"), 0).alias("b")
    ).collect()
    assert [tuple(r) for r in found] == [(1.02, 2.0), (-3.13, 4.0), (None, None)]


def test_clip_and_ratio_keep_missing(spark):
    frame = spark.createDataFrame([(None, 0.0), (5.0, 2.0)], "a double, b double")
    found = frame.select(
        X.clip(F.col("a"), 0.0, 1.0).alias("c"), X.safe_ratio(F.lit(4.0), F.col("b")).alias("r")
    ).collect()
    assert [tuple(r) for r in found] == [(None, None), (1.0, 2.0)]


def test_seeded_mix_is_plain_arithmetic(spark):
    ids = [0, 1, 2**32 - 1, 2**40 + 7]
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = [r[0] for r in frame.select(X.seeded_mix(F.col("id"), 42)).collect()]
    assert found == [(i * 2654435761 + 42 * 2246822519) % 2**32 for i in ids]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    facts = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
        .cast("bigint").alias("key"),
    )
    lookup = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    expected = sorted(facts.join(lookup, "key", how).select("id", "value").collect())
    assert joins.fits_broadcast(lookup)
    small = joins.lookup_join(facts, lookup, "key", how, "id")
    assert sorted(small.select("id", "value").collect()) == expected
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joins.fits_broadcast(lookup)
        spread = joins.lookup_join(facts, lookup, "key", how, "id")
        assert sorted(spread.select("id", "value").collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_heavy_hitters_are_spread(spark):
    """A third of the rows share a key, another third has none: no task gets much more than its share."""
    facts = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("bigint").alias("key")
    )
    lookup = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    hot = facts.sparkSession.range(1).select(joins.heavy_hitters(facts, "key", 8).alias("hot")).first()["hot"]
    assert hot == {7: 6}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(facts, lookup, "key", "left", "id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 2.5 * sorted(sizes)[len(sizes) // 2]
        plain = facts.join(lookup, "key", "left").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in plain) > 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_no_heavy_hitters(spark):
    one = spark.range(1)
    assert one.select(joins.heavy_hitters(spark.range(5000), "id", 8).alias("hot")).first()["hot"] == {}
    assert one.select(joins.heavy_hitters(spark.range(0), "id", 8).alias("hot")).first()["hot"] == {}
    texts = spark.range(5000).select(F.when(F.col("id") < 2500, "a").otherwise(F.col("id").cast("string")).alias("k"))
    assert one.select(joins.heavy_hitters(texts, "k", 8).alias("hot")).first()["hot"] == {"a": 8}


def test_left_join_many_equals_a_left_join(spark):
    left = spark.range(50).select(F.col("id").alias("key"), F.lit("x").alias("a"))
    right = spark.range(300).select(
        F.when(F.col("id") < 100, 3).otherwise(F.col("id") % 70).cast("bigint").alias("key"),
        F.col("id").alias("b"),
    )
    expected = left.join(right, "key", "left")
    for skewed in (False, True):
        found = joins.left_join_many(left, right, "key", skewed).select(*expected.columns)
        assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


def test_sums_beyond_doubles_are_exact(spark):
    rows = spark.range(40_000).select((F.col("id") * 7 + 2**50 + 1).alias("x"))
    total = F.sum(X.whole(F.col("x")))
    found = {rows.repartition(n, "x").agg(total).first()[0] for n in (1, 3, 16)}
    assert found == {sum(i * 7 + 2**50 + 1 for i in range(40_000))}


def test_median_of_even_count(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "a double")
    assert ranks.medians(frame, ["a"]) == {"a": 2.5}
    assert ranks.medians(frame.filter("a > 9"), ["a"]) == {"a": None}


def test_one_round_suffices_for_heavy_tails(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_LISTED_ROWS", 60)
    rounds, narrow = [], ranks._narrow
    monkeypatch.setattr(ranks, "_narrow", lambda *args: rounds.append(1) or narrow(*args))
    columns = {
        "powers": [10.0 ** (i / 60) * (-1) ** i for i in range(18_001)],
        "outliers": [float(i % 9_000) for i in range(17_997)] + [1e300, -1e300, 1e200, 1e100],
        "shared": [3.0] * 12_000 + [1e12 * i for i in range(6_001)],
    }
    frame = spark.createDataFrame(list(zip(*columns.values())), list(columns)).repartition(7)
    found = ranks.medians(frame, list(columns))
    assert found == {name: statistics.median(values) for name, values in columns.items()}
    assert len(rounds) == 1


def test_medians_through_sketch_rounds(spark, narrow_rounds):
    chooser = random.Random(3)
    columns = {
        "smooth": [chooser.gauss(0, 1) for _ in range(400)],
        "hot": [7.0] * 200 + [chooser.random() * 1e6 for _ in range(200)],
        "tiny": [1e-12 * i for i in range(399)] + [1e15],
        "ends": [0.0] * 200 + [1.0] * 200,
    }
    frame = spark.createDataFrame(list(zip(*columns.values())), list(columns))
    found = ranks.medians(frame, list(columns))
    assert found == {name: statistics.median(values) for name, values in columns.items()}


@pytest.mark.parametrize("position", [0, 1, 37, 150, 299, 300])
def test_sorts_before_takes_exactly_the_first_rows(spark, narrow_rounds, position):
    frame = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).cast("bigint").alias("a"),
        (F.col("id") * 17 % 300).alias("b"),
    )
    taken = frame.filter(ranks.sorts_before(frame, [F.col("a"), F.col("b")], position))
    expected = sorted((r["a"], r["b"]) for r in frame.collect())[:position]
    assert sorted((r["a"], r["b"]) for r in taken.collect()) == expected


def test_running_totals(spark):
    frame = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 7).alias("v"))
    found = {r["k"]: r["v_before"] for r in ranks.running_totals(frame, ["k"], ["v"]).collect()}
    total, expected = 0, {}
    for row in sorted(frame.collect()):
        expected[row["k"]] = total
        total += row["v"]
    assert found == expected


def test_extents_are_one_row_of_figures(spark):
    """Counts and ends of all columns come from the rows as they stand, without a cell for each value."""
    frame = spark.createDataFrame([(1.5, None), (None, None), (-2.0, None), (7.0, None)], "a double, b int")
    assert ranks._extents(frame, [F.col("a"), F.col("b"), F.col("a") + 1], "double") == [(3, -2.0, 7.0), (0, None, None), (3, -1.0, 8.0)]
    assert ranks._extents(frame.limit(0), [F.col("a")], "double") == [(0, None, None)]
