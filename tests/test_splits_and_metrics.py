from datetime import timedelta

import pytest
from helpers import PURCHASE, rows
from pyspark.sql import functions as F

from sellerscope.operators import metrics, splits


@pytest.fixture
def timed(spark):
    """400 rows of which a third share one moment."""
    data = [
        (i, PURCHASE + timedelta(days=50 if i % 3 == 0 else i % 90), i % 5, int(i % 4 == 0))
        for i in range(400)
    ]
    schema = "order_id bigint, order_purchase_timestamp timestamp_ntz, review_score int, is_negative int"
    return spark.createDataFrame(data, schema)


def test_time_split_cuts_at_the_exact_row(timed):
    found = splits.time_split(timed, validation_fraction=0.1).collect()
    ordered = sorted(found, key=lambda r: (r["order_purchase_timestamp"], r["order_id"]))
    assert [r["split"] for r in ordered] == ["train"] * 288 + ["val"] * 32 + ["test"] * 80


def test_time_split_with_text_ids(timed):
    named = timed.withColumn("order_id", F.concat(F.lit("id-"), F.col("order_id").cast("string")))
    sizes = {r["split"]: r["count"] for r in splits.time_split(named).groupBy("split").count().collect()}
    assert sizes == {"train": 320, "test": 80}


def test_stratified_split_keeps_shares(timed):
    split = splits.stratified_split(timed, "is_negative", "order_id")
    sizes = {(r["is_negative"], r["split"]): r["count"] for r in split.groupBy("is_negative", "split").count().collect()}
    assert sizes == {(1, "test"): 20, (1, "train"): 80, (0, "test"): 60, (0, "train"): 240}


def test_seeded_sample_is_fixed_by_the_seed(timed):
    first = sorted(r["order_id"] for r in splits.seeded_sample(timed, "order_id", 50, 1).collect())
    again = sorted(r["order_id"] for r in splits.seeded_sample(timed.repartition(7), "order_id", 50, 1).collect())
    other = sorted(r["order_id"] for r in splits.seeded_sample(timed, "order_id", 50, 2).collect())
    assert first == again and first != other and len(set(first)) == 50


def test_class_weights(timed):
    found = {r["is_negative"]: r for r in rows(splits.class_weights(timed))}
    assert (found[0]["n_rows"], found[1]["n_rows"]) == (300, 100)
    assert found[0]["balanced_weight"] == pytest.approx(400 / 600)
    assert found[1]["balanced_weight"] == pytest.approx(2.0)
    assert found[1]["pos_weight"] == 3.0
    weighted = splits.with_balanced_weight(timed, "is_negative").agg(F.sum("weight")).first()[0]
    assert weighted == pytest.approx(400)


def test_oversample_balances_and_only_repeats_positives(timed):
    drawn = splits.oversample(timed, ["order_id"])
    sizes = {r["is_negative"]: r["count"] for r in drawn.groupBy("is_negative").count().collect()}
    assert sizes == {0: 300, 1: 300}
    assert drawn.distinct().join(timed, timed.columns, "left_anti").count() == 0
    assert drawn.filter("is_negative = 0").distinct().count() == 300


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_tied_scores_count_half(spark):
    frame = scored(spark, [(1, 0.5), (0, 0.5)])
    assert metrics.roc_auc(frame).first()["roc_auc"] == 0.5
    assert metrics.average_precision(frame).first()["average_precision"] == 0.5


def test_curve_figures_against_definitions(spark):
    pairs = [(i * 7 % 5 % 2, (i * 13 % 17) / 17) for i in range(60)]
    found = metrics.evaluate(scored(spark, pairs), "m").first()
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    precision = 0.0
    for level in sorted({s for _, s in pairs}, reverse=True):
        taken = [y for y, s in pairs if s >= level]
        precision += sum(1 for p in pos if p == level) / len(pos) * sum(taken) / len(taken)
    assert found["roc_auc"] == pytest.approx(auc, abs=5e-5)
    assert found["pr_auc"] == pytest.approx(precision, abs=5e-5)


def test_metrics_without_positive_predictions(spark):
    frame = metrics.with_prediction(scored(spark, [(1, 0.1), (0, 0.2), (0, 0.3)]))
    found = metrics.binary_metrics(frame).first()
    assert (found["f1"], found["precision"], found["recall"]) == (0.0, 0.0, 0.0)
    assert found["accuracy"] == pytest.approx(2 / 3)
    cells = {(r["label"], r["prediction"]): r["n"] for r in rows(metrics.confusion_matrix(frame))}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_classification_report_identities(spark):
    frame = metrics.with_prediction(scored(spark, [(i % 2, (i * 7 % 10) / 10) for i in range(40)]))
    report = {r["class"]: r for r in rows(metrics.classification_report(frame))}
    single = metrics.binary_metrics(frame).first()
    assert report["negative"]["f1"] == single["f1"]
    assert report["accuracy"]["precision"] == single["accuracy"]
    assert report["satisfied"]["support"] + report["negative"]["support"] == 40
    assert report["weighted avg"]["recall"] == pytest.approx(single["accuracy"])


def test_risk_tier_edges(spark):
    frame = scored(spark, [(0, 0.5), (0, 0.51), (0, 0.3), (0, 0.31)])
    tiers = {r["score"]: r["risk_tier"] for r in rows(metrics.risk_tiers(frame))}
    assert tiers == {0.5: "moderate", 0.51: "high", 0.3: "low", 0.31: "moderate"}


def test_model_ranking(spark):
    frame = spark.createDataFrame([("a", 0.7), ("b", 0.9), ("c", 0.8)], "model string, roc_auc double")
    assert [r["model"] for r in metrics.model_ranking(frame).collect()] == ["b", "c", "a"]
    assert metrics.best_model(frame).first()["model"] == "b"
