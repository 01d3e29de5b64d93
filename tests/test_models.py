import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sellerscope.operators import attribution, features, models
from sellerscope.session import stage
from sellerscope.settings import FEATURE_COLUMNS
from sellerscope.sources import artifacts


@pytest.fixture(scope="module")
def matrix(generated):
    return stage(features.order_features(generated), "test-matrix")


@pytest.fixture(scope="module")
def comparison(matrix):
    return models.compare_models(matrix, shallow_trees=4, deep_trees=4)


def test_comparison(comparison):
    found = comparison.metrics.collect()
    assert [r["roc_auc"] for r in found] == sorted((r["roc_auc"] for r in found), reverse=True)
    assert comparison.best == found[0]["model"] and len(found) == 3
    assert all(0.7 < r["roc_auc"] <= 1.0 and 0 <= r["f1"] <= 1 for r in found)


def test_saved_model_gives_the_same_scores(spark, matrix, comparison, tmp_path):
    model = comparison.models["logistic"]
    path = str(tmp_path / "model")
    artifacts.save_model(model, path, "logistic", FEATURE_COLUMNS, comparison.metrics)
    restored, name, columns, metrics = artifacts.load_model(spark, path)
    assert (name, columns) == ("logistic", FEATURE_COLUMNS)
    assert sorted(metrics.collect()) == sorted(comparison.metrics.collect())
    before = models.score(model, matrix, "order_id", "review_score").collect()
    after = models.score(restored, matrix, "order_id", "review_score").collect()
    assert sorted(before) == sorted(after)
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, str(tmp_path / "none"))


def test_logistic_scores_once_the_session_has_observed_a_figure(spark, matrix):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    model = models.fit_logistic(matrix, max_iter=2)
    assert models.scored_labels(model, matrix).count() == matrix.count()


def test_predictions_follow_the_threshold(matrix, comparison):
    found = models.predictions(comparison.models["boosted_shallow"], matrix, "order_id")
    assert found.filter((F.col("score") >= 0.5) != (F.col("prediction") == 1)).count() == 0
    assert found.count() == matrix.count()


def test_perceptron(matrix):
    result = models.train_mlp(matrix, hidden=(8,), max_rounds=3)
    found = result.metrics.first()
    assert found["roc_auc"] > 0.6 and 1 <= found["epochs_trained"] <= 3
    assert models.score(result.model, matrix, "order_id").count() == matrix.count()


def test_split_is_exact_inside_equal_rows(matrix):
    one = matrix.limit(1)
    repeated = one.crossJoin(one.sparkSession.range(101).select()).select(*one.columns)
    parts = models.timed_parts(repeated, validation_fraction=0.1)
    assert {name: part.count() for name, part in parts.items()} == {"train": 72, "val": 8, "test": 21}


def test_sampled_contributions_add_up(matrix, comparison):
    model = comparison.models["boosted_shallow"]
    parts = attribution.sampled_attribution(matrix, model, rows=40, permutations=2)
    per_row = parts.groupBy("row_no").agg(F.sum("contribution").alias("total"), F.count("*").alias("n"))
    found = per_row.agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(found) == (40, len(FEATURE_COLUMNS), len(FEATURE_COLUMNS))
    sample = attribution.seeded_sample(matrix, "order_id", 40)
    mean = sample.agg(*[F.avg(c).alias(c) for c in FEATURE_COLUMNS])
    base = models.score(model, mean).first()["score"]
    gaps = sorted(r["score"] - base for r in models.score(model, sample, "order_id").collect())
    totals = sorted(r["total"] for r in per_row.collect())
    assert totals == pytest.approx(gaps, abs=1e-9)
    assert attribution.mean_absolute(parts).count() == len(FEATURE_COLUMNS)


def test_linear_attribution(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "a double, b double")
    found = {r[0]: r[1] for r in attribution.linear_attribution(frame, {"a": -3.0, "b": 1.0}).collect()}
    assert found == {"a": pytest.approx(4.0), "b": pytest.approx(4 / 3)}


def test_scenarios(spark, matrix, comparison):
    columns = "name string, " + ", ".join(f"{c} double" for c in models.SCENARIO_COLUMNS)
    given = spark.createDataFrame(
        [("good", 3.0, 30.0, 4.8, 100.0, 20.0, 1.0), ("free", 30.0, 10.0, 1.5, 0.0, 20.0, 1.0)], columns
    )
    typical = {c: float(i) for i, c in enumerate(FEATURE_COLUMNS)}
    found = {r["name"]: r for r in models.scenario_rows(given, typical).collect()}
    assert found["good"]["freight_ratio"] == 0.2 and found["free"]["freight_ratio"] == 20.0
    assert found["good"]["payment_value"] == typical["payment_value"]
    scores = models.score(comparison.models["logistic"], models.scenario_rows(given, typical), "name")
    risk = {r["name"]: r["score"] for r in scores.collect()}
    assert risk["good"] < risk["free"]
