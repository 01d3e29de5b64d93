"""Mean absolute contribution of every feature to a model's output."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerscope.operators.models import score
from sellerscope.operators.splits import seeded_sample
from sellerscope.session import stage
from sellerscope.settings import FEATURE_COLUMNS, RANDOM_SEED


def linear_attribution(frame: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean |w * (x - mean x)| per feature, in log-odds; exact for a linear model."""
    means = frame.agg(*[F.avg(c).alias(c) for c in coefficients]).select(F.struct("*")).scalar()
    parts = [
        F.avg(F.abs(F.lit(weight) * (F.col(name) - F.col(f"_mean.{name}")))).alias(name)
        for name, weight in coefficients.items()
    ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), F.col(name).alias("mean_abs_shap"))
            for name in coefficients
        ]
    )
    return (
        frame.withColumn("_mean", means)
        .agg(*parts)
        .select(F.explode(rows).alias("row"))
        .select("row.*")
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def logistic_coefficients(model: PipelineModel, columns: Sequence[str] = FEATURE_COLUMNS) -> dict[str, float]:
    """Weight per scaled feature of a fitted logistic pipeline."""
    values = model.stages[-1].coefficients.toArray()
    return {f"scaled_{name}": float(v) for name, v in zip(columns, values)}


def sampled_attribution(
    frame: DataFrame,
    model: PipelineModel,
    row_id: str = "order_id",
    rows: int | None = None,
    permutations: int = 4,
    columns: Sequence[str] = FEATURE_COLUMNS,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Shapley contributions per (row, feature), for any fitted model.

    Features are switched from the rows' mean to the row's value one at a time, in a few fixed
    random orders; a feature's contribution is the change of the probability at its switch, averaged
    over the orders. Contributions of a row add up to its probability less the mean row's.
    All rows are explained, or ``rows`` of them in seeded order.
    """
    sample = stage(
        (frame if rows is None else seeded_sample(frame, row_id, rows, seed))
        .select(*columns)
        .withColumn("row_no", F.monotonically_increasing_id()),
        "attribution-sample",
    )
    chooser = random.Random(seed)
    orders = [chooser.sample(range(len(columns)), len(columns)) for _ in range(permutations)]
    # steps[p][f]: how many switches it takes in order p until feature f has its own value.
    steps = F.array(
        *[F.array(*[F.lit(order.index(f) + 1) for f in range(len(columns))]) for order in orders]
    )
    mean = sample.agg(*[F.avg(c).alias(c) for c in columns]).select(F.struct("*")).scalar()
    staged = (
        sample.withColumn("_mean", mean)
        .withColumn("order_no", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_steps", F.get(steps, F.col("order_no")))
        .withColumn("switched", F.explode(F.sequence(F.lit(0), F.lit(len(columns)))))
    )
    mixed = staged.select(
        "row_no",
        "order_no",
        "switched",
        *[
            F.when(F.get("_steps", F.lit(i)) <= F.col("switched"), F.col(c))
            .otherwise(F.col(f"_mean.{c}"))
            .alias(c)
            for i, c in enumerate(columns)
        ],
    )
    scored = score(model, mixed, "row_no", "order_no", "switched")
    # Put the scores of one pass in order: at most features + 1 values.
    passes = scored.groupBy("row_no", "order_no").agg(
        F.sort_array(F.collect_list(F.struct("switched", "score"))).alias("path")
    )
    names = F.array(*[F.array(*[F.lit(columns[f]) for f in order]) for order in orders])
    gains = F.transform(
        F.sequence(F.lit(1), F.lit(len(columns))),
        lambda k: F.struct(
            F.get(F.get(names, F.col("order_no")), k - 1).alias("feature"),
            (F.get("path", k)["score"] - F.get("path", k - 1)["score"]).alias("gain"),
        ),
    )
    return (
        passes.select("row_no", F.explode(gains).alias("g"))
        .groupBy("row_no", "g.feature")
        .agg(F.avg("g.gain").alias("contribution"))
    )


def mean_absolute(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )
