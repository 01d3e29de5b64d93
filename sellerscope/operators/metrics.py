"""Exact evaluation of binary predictions.

Input frames carry ``label`` (0/1), ``score`` (double) and, where classes are compared,
``prediction`` (0/1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import round_half_even, tiers
from sellerscope.functions.ranks import running_totals


def with_prediction(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def risk_tiers(scored: DataFrame) -> DataFrame:
    """Risk tier of every score: above 0.5 high, above 0.3 moderate, else low."""
    steps = [(0.5, "high"), (0.3, "moderate"), (None, "low")]
    return scored.withColumn("risk_tier", tiers(F.col("score"), steps, strict=True))


def score_curve(scored: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score and above it, from the best score down."""
    counted = scored.groupBy((-F.col("score")).alias("order")).agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("label")).cast("bigint")).alias("neg"),
    )
    return running_totals(counted, ["order"], ["pos", "neg"])


def _curve_figures(curve: DataFrame) -> DataFrame:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_up_to = F.col("pos_before") + F.col("pos")
    all_up_to = pos_up_to + F.col("neg_before") + F.col("neg")
    # A negative loses to the positives above it and shares the ones at its own score.
    won = F.sum(neg * (F.col("pos_before") + pos / 2.0))
    pairs = F.sum(pos) * F.sum(neg)
    return curve.agg(
        F.try_divide(won, pairs).alias("roc_auc"),
        F.try_divide(F.sum(pos * pos_up_to / all_up_to), F.sum(pos)).alias("average_precision"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, tied scores counting one half."""
    return _curve_figures(score_curve(scored)).select("roc_auc")


def average_precision(scored: DataFrame) -> DataFrame:
    """Step sum of precision over recall increments."""
    return _curve_figures(score_curve(scored)).select("average_precision")


def _cells(predicted: DataFrame) -> DataFrame:
    """One row: the four counts of the confusion matrix."""
    label, prediction = F.col("label"), F.col("prediction")
    return predicted.agg(
        F.count_if((label == 0) & (prediction == 0)).alias("tn"),
        F.count_if((label == 0) & (prediction == 1)).alias("fp"),
        F.count_if((label == 1) & (prediction == 0)).alias("fn"),
        F.count_if((label == 1) & (prediction == 1)).alias("tp"),
    )


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def binary_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy and precision, recall, F1 of the positive class, 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return _cells(predicted).select(
        _or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """Rows per (label, prediction), all four listed."""
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
            for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return _cells(predicted).select(F.explode(rows).alias("row")).select("row.*")


def classification_report(
    predicted: DataFrame, names: tuple[str, str] = ("satisfied", "negative")
) -> DataFrame:
    """Precision, recall, F1 and support per class, their plain and weighted means, accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def figures(hit: Column, wrongly: Column, missed: Column) -> list[Column]:
        return [
            _or_zero(hit, hit + wrongly),
            _or_zero(hit, hit + missed),
            _or_zero(2 * hit, 2 * hit + wrongly + missed),
        ]

    first, second = figures(tn, fn, fp), figures(tp, fp, fn)
    n_first, n_second = tn + fp, tp + fn
    total = n_first + n_second
    accuracy = _or_zero(tn + tp, total)
    measures = ("precision", "recall", "f1")

    def row(name: str, values: list[Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(m) for v, m in zip(values, measures)],
            support.alias("support"),
        )

    rows = F.array(
        row(names[0], first, n_first),
        row(names[1], second, n_second),
        row("accuracy", [accuracy] * 3, total),
        row("macro avg", [(a + b) / 2 for a, b in zip(first, second)], total),
        row(
            "weighted avg",
            [_or_zero(a * n_first + b * n_second, total) for a, b in zip(first, second)],
            total,
        ),
    )
    return _cells(predicted).select(F.explode(rows).alias("row")).select("row.*")


def evaluate(scored: DataFrame, name: str, threshold: float = 0.5) -> DataFrame:
    """One comparison row of a model: ROC-AUC, average precision, F1 and accuracy, 4 decimals."""
    curve = _curve_figures(score_curve(scored)).select(F.struct("*")).scalar()
    return (
        binary_metrics(with_prediction(scored, threshold))
        .withColumn("curve", curve)
        .select(
            F.lit(name).alias("model"),
            round_half_even(F.col("curve.roc_auc"), 4).alias("roc_auc"),
            round_half_even(F.col("curve.average_precision"), 4).alias("pr_auc"),
            round_half_even(F.col("f1"), 4).alias("f1"),
            round_half_even(F.col("accuracy"), 4).alias("accuracy"),
        )
    )


def model_ranking(metrics: DataFrame) -> DataFrame:
    """Compared models, best ROC-AUC first."""
    return metrics.orderBy(F.desc("roc_auc"), "model")


def best_model(metrics: DataFrame) -> DataFrame:
    return model_ranking(metrics).limit(1)
