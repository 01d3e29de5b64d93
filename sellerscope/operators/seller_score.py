"""The 0-100 seller score, its components and the summaries built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import (
    clip,
    days,
    on_time_flag,
    rate,
    round_half_even,
    tiers,
    whole,
)
from sellerscope.functions.ranks import medians
from sellerscope.plans.views import margin_micros
from sellerscope.session import stage
from sellerscope.settings import (
    LOW_SCORE_MAX,
    SCORE_GRADES,
    SCORE_WEIGHTS,
    SCORED_SELLER_MIN_ORDERS,
)
from sellerscope.tables import Tables

LEADERBOARD_COLUMNS = [
    "seller_id",
    "seller_state",
    "n_orders",
    "avg_review_score",
    "on_time_rate",
    "trust_score",
    "trust_grade",
]


def latest_reviews(tables: Tables) -> DataFrame:
    """One score per reviewed order: the review answered last, the higher score on a tie."""
    latest = F.max_by(
        "review_score",
        F.struct("review_answer_timestamp", F.coalesce("review_score", F.lit(-1))),
    )
    return tables.order_reviews.groupBy("order_id").agg(latest.alias("review_score"))


def seller_stats(tables: Tables, min_orders: int = SCORED_SELLER_MIN_ORDERS) -> DataFrame:
    """Order-level figures per seller with enough distinct orders."""
    pairs = tables.order_items.select("seller_id", "order_id").distinct()
    orders = tables.orders.select(
        "order_id",
        "order_status",
        margin_micros().alias("margin_micros"),
    ).join(latest_reviews(tables), "order_id", "left")
    margin = F.col("margin_micros")
    complaint = F.when(F.col("review_score") <= LOW_SCORE_MAX, 1.0).otherwise(0.0)
    canceled = F.when(F.col("order_status") == "canceled", 1.0).otherwise(0.0)
    totals = (
        pairs.join(orders, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("n_orders"),
            F.avg("review_score").alias("avg_review_score"),
            F.avg(on_time_flag(margin).cast("double")).alias("on_time_rate"),
            F.avg(complaint).alias("complaint_rate"),
            days(rate(F.sum(whole(margin)), F.count(margin))).alias("avg_days_early"),
            F.avg(canceled).alias("cancel_rate"),
        )
        .filter(F.col("n_orders") >= min_orders)
    )
    return totals.join(tables.sellers.select("seller_id", "seller_state"), "seller_id", "left").select(
        "seller_id", "seller_state", *[c for c in totals.columns if c != "seller_id"]
    )


def _spread_to_unit(value: Column, low: Column, high: Column) -> Column:
    spread = high - low
    return F.when(spread < 1e-9, F.lit(0.0)).otherwise((value - low) / spread)


def score_components(stats: DataFrame) -> DataFrame:
    """Six components in [0, 1] per reviewed seller, as unrounded ``u_`` columns."""
    # The ranges and the scores both start from the per-seller rows, so these are written once.
    rated = stage(stats.dropna(subset=["avg_review_score"]), "seller-stats")
    early = clip(F.col("avg_days_early"), -10.0, 20.0)
    volume = F.log1p(F.col("n_orders").cast("double"))
    ranged = rated.withColumn("_early", early).withColumn("_volume", volume)
    extent = ranged.agg(
        F.min("_early").alias("early_low"),
        F.max("_early").alias("early_high"),
        F.min("_volume").alias("volume_low"),
        F.max("_volume").alias("volume_high"),
    )
    ranged = ranged.withColumn("_x", extent.select(F.struct("*")).scalar())
    early_low = F.col("_x.early_low")
    components = {
        "avg_review_score": (F.col("avg_review_score") - 1) / 4.0,
        "on_time_delivery_rate": clip(F.col("on_time_rate"), 0.0, 1.0),
        "low_complaint_rate": 1.0 - clip(F.col("complaint_rate"), 0.0, 1.0),
        "delivery_speed": _spread_to_unit(
            F.coalesce("_early", early_low), early_low, F.col("_x.early_high")
        ),
        "order_volume": _spread_to_unit(
            F.col("_volume"), F.col("_x.volume_low"), F.col("_x.volume_high")
        ),
        "cancel_rate_penalty": 1.0 - clip(F.col("cancel_rate"), 0.0, 1.0),
    }
    return ranged.select(
        *stats.columns,
        *[F.coalesce(c, F.lit(0.0)).alias(f"u_{name}") for name, c in components.items()],
    )


def seller_trust_scores(
    tables: Tables,
    weights: dict[str, float] = SCORE_WEIGHTS,
    grades: list[tuple[int, str]] = SCORE_GRADES,
    min_orders: int = SCORED_SELLER_MIN_ORDERS,
) -> DataFrame:
    """Score, rounded components and grade per seller, best first."""
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("score weights must add up to 1")
    components = score_components(seller_stats(tables, min_orders))
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(f"u_{name}") * F.lit(weight)
    scored = components.withColumn("trust_score", round_half_even(F.lit(100.0) * total, 2))
    return scored.select(
        *[c for c in components.columns if not c.startswith("u_")],
        "trust_score",
        *[round_half_even(F.col(f"u_{name}"), 4).alias(f"c_{name}") for name in weights],
        grade_of(F.col("trust_score"), grades).alias("trust_grade"),
    ).orderBy(F.desc("trust_score"), "seller_id")


def grade_of(score: Column, grades: list[tuple[int, str]] = SCORE_GRADES) -> Column:
    """Grade of a (rounded) score; the last grade takes everything below its own bound too."""
    return tiers(score, [*grades[:-1], (None, grades[-1][1])])


def trust_breakdown(scores: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """One row per seller and component: value, weight, points contributed."""
    rows = [
        F.struct(
            F.lit(name).alias("component"),
            F.col(f"c_{name}").alias("normalized_value"),
            F.lit(weight).alias("weight"),
            round_half_even(F.col(f"c_{name}") * F.lit(weight) * 100, 2).alias("contribution"),
        )
        for name, weight in weights.items()
    ]
    return scores.select("seller_id", F.explode(F.array(*rows)).alias("part")).select(
        "seller_id", "part.*"
    )


def grade_counts(scores: DataFrame, grades: list[tuple[int, str]] = SCORE_GRADES) -> DataFrame:
    """Sellers per grade, every grade listed."""
    listed = [F.count_if(F.col("trust_grade") == label).alias(label) for _, label in grades]
    cells = F.array(
        *[F.struct(F.lit(g).alias("trust_grade"), F.col(f"`{g}`").alias("n_sellers")) for _, g in grades]
    )
    return scores.agg(*listed).select(F.explode(cells).alias("row")).select("row.*")


def trust_summary(scores: DataFrame) -> DataFrame:
    """Sellers scored, mean, median, lowest and highest score, sellers with the top grade."""
    middle = medians(scores, ["trust_score"])["trust_score"]
    score = F.col("trust_score")
    return scores.agg(
        F.count("*").alias("n_sellers"),
        F.avg(score).alias("mean_score"),
        F.lit(middle).cast("double").alias("median_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.count_if(F.col("trust_grade").startswith("A")).alias("n_a_grade"),
    )


def trust_histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over the score range; the highest score falls into the last bin."""
    extent = scores.select(
        F.struct(F.min("trust_score").alias("low"), F.max("trust_score").alias("high"))
    ).scalar()
    placed = scores.select("trust_score", extent.alias("x"))
    width = (F.col("x.high") - F.col("x.low")) / F.lit(float(bins))
    slot = F.floor(F.try_divide(F.col("trust_score") - F.col("x.low"), width)).cast("int")
    counted = (
        placed.select(F.least(F.coalesce(slot, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = every.select("bin", extent.alias("x"))
    step = (F.col("x.high") - F.col("x.low")) / F.lit(float(bins))
    return (
        edges.join(counted, "bin", "left")
        .select(
            "bin",
            (F.col("x.low") + F.col("bin") * step).alias("bin_start"),
            F.coalesce("n", F.lit(0)).alias("n_sellers"),
        )
        .orderBy("bin")
    )


def trust_top_bottom(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best and the ``n`` lowest scored sellers."""
    shown = scores.select(*LEADERBOARD_COLUMNS)
    best = shown.orderBy(F.desc("trust_score"), "seller_id").limit(n)
    worst = shown.orderBy("trust_score", F.desc("seller_id")).limit(n)
    return best.withColumn("end", F.lit("top")).unionByName(worst.withColumn("end", F.lit("bottom")))


def grades_present(scores: DataFrame) -> DataFrame:
    return scores.select("trust_grade").distinct().orderBy("trust_grade")


def sellers_of_grade(scores: DataFrame, grade: str | None = None, rows: int | None = None) -> DataFrame:
    """Leaderboard columns of one grade (all if none is named), best first, optionally the first rows."""
    chosen = scores if grade is None else scores.filter(F.col("trust_grade") == grade)
    view = chosen.select(*LEADERBOARD_COLUMNS).orderBy(F.desc("trust_score"), "seller_id")
    return view if rows is None else view.limit(rows)
