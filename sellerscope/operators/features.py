"""The order-level feature matrix: joins, derived columns, label, imputation, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sellerscope.functions.expressions import (
    days_between,
    hours_between,
    rate,
    round_half_even,
    safe_ratio,
)
from sellerscope.functions.joins import lookup_join
from sellerscope.functions.ranks import medians
from sellerscope.plans.views import review_facts
from sellerscope.session import stage
from sellerscope.settings import FEATURE_COLUMNS, NEGATIVE_LABEL_MAX_SCORE
from sellerscope.tables import Tables

KEPT_COLUMNS = [
    "order_id",
    "customer_state",
    "review_score",
    "is_negative",
    "order_purchase_timestamp",
]
PROFILE_COLUMNS = [
    "delivery_days",
    "estimated_delivery_days",
    "freight_ratio",
    "seller_avg_review_hist",
    "price_total",
]


def basket_totals(tables: Tables) -> DataFrame:
    """One row per order: item, product and category figures in a single grouping.

    The number of sellers comes with ``seller_figures``, so one distinct count is left here and
    rows are not repeated for it.
    """
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    products = tables.products.select(
        "product_id",
        "product_category_name",
        "product_weight_g",
        volume.alias("product_volume_cm3"),
        "product_photos_qty",
        "product_description_lenght",
    )
    items = tables.order_items.select("order_id", "product_id", "price", "freight_value")
    return (
        lookup_join(items, products, "product_id", "left", spread_by="order_id")
        .groupBy("order_id")
        .agg(
            F.sum("price").cast("double").alias("price_total"),
            F.sum("freight_value").cast("double").alias("freight_total"),
            F.count("*").alias("n_items"),
            F.count_distinct("product_category_name").alias("n_categories"),
            F.avg("product_weight_g").alias("product_weight_g"),
            F.avg("product_volume_cm3").alias("product_volume_cm3"),
            F.avg("product_photos_qty").alias("product_photos_qty"),
            F.avg("product_description_lenght").alias("product_description_lenght"),
        )
    )


def payment_totals(tables: Tables) -> DataFrame:
    return tables.order_payments.groupBy("order_id").agg(
        F.sum("payment_value").cast("double").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
    )


def seller_figures(tables: Tables) -> DataFrame:
    """Per order: its sellers, and the mean review average of its sellers weighted by item.

    Every step works on (seller, order) rows with an item count, so neither a large basket nor a
    popular seller multiplies rows. ``known_sellers`` counts the sellers that have any review.
    """
    pairs = tables.order_items.groupBy("seller_id", "order_id").agg(F.count("*").alias("n_items"))
    scored = review_facts(tables).select("order_id", "n_scored", "score_sum")
    averages = (
        pairs.join(scored, "order_id")
        .groupBy("seller_id")
        .agg(
            rate(
                F.sum(F.col("n_items") * F.col("score_sum")),
                F.sum(F.col("n_items") * F.col("n_scored")),
            ).alias("seller_avg"),
            F.lit(1).alias("known"),
        )
    )
    weight = F.when(F.col("seller_avg").isNotNull(), F.col("n_items"))
    return (
        lookup_join(pairs, averages, "seller_id", "left", spread_by="order_id")
        .groupBy("order_id")
        .agg(
            F.count("seller_id").alias("n_sellers"),
            F.count("known").alias("known_sellers"),
            rate(F.sum(F.col("n_items") * F.col("seller_avg")), F.sum(weight)).alias(
                "seller_avg_review_hist"
            ),
        )
    )


def seller_history(tables: Tables) -> DataFrame:
    """Mean review average of the sellers of every order that has a reviewed seller."""
    return (
        seller_figures(tables)
        .filter("known_sellers > 0")
        .select("order_id", "seller_avg_review_hist")
    )


def state_codes(states: DataFrame, column: str = "customer_state") -> DataFrame:
    """Code of every state present: its place in sorted order, from 0.

    The window orders distinct state names only, a short administrative list.
    """
    distinct = states.select(column).filter(F.col(column).isNotNull()).distinct()
    position = F.row_number().over(Window.orderBy(column)) - 1
    return distinct.select(column, position.cast("int").alias(f"{column}_code"))


def order_inputs(tables: Tables) -> DataFrame:
    """One row per delivered order: basket, payment, seller, customer and delivery figures."""
    purchase = "order_purchase_timestamp"
    orders = tables.orders.filter(F.col("order_status") == "delivered").select(
        "order_id",
        "customer_id",
        days_between(purchase, "order_delivered_customer_date").alias("delivery_days"),
        hours_between(purchase, "order_approved_at").alias("approval_delay_hours"),
        days_between(purchase, "order_estimated_delivery_date").alias("estimated_delivery_days"),
        purchase,
    )
    # Customers come first; the other inputs are one row per order and share its partitioning.
    return (
        lookup_join(
            orders,
            tables.customers.select("customer_id", "customer_state"),
            "customer_id",
            "left",
            spread_by="order_id",
        )
        .join(basket_totals(tables), "order_id")
        .join(payment_totals(tables), "order_id", "left")
        .join(seller_figures(tables), "order_id", "left")
    )


def reviewed_orders(tables: Tables) -> DataFrame:
    """Order inputs per scored review.

    The order rows are written first: a join of two plain shuffles is the form in which adaptive
    execution can split an order with very many reviews.
    """
    scored = tables.order_reviews.filter("review_score IS NOT NULL").select(
        "order_id", "review_score"
    )
    return stage(order_inputs(tables), "order-inputs", "zstd").join(scored, "order_id")


def derived_features(
    reviewed: DataFrame, label_max_score: int = NEGATIVE_LABEL_MAX_SCORE
) -> DataFrame:
    """Add the features that follow from other columns, and the label."""
    moment = F.col("order_purchase_timestamp")
    return (
        reviewed.withColumn("freight_ratio", safe_ratio(F.col("freight_total"), F.col("price_total")))
        .withColumn("purchase_dow", F.weekday(moment))
        .withColumn("purchase_month", F.month(moment))
        .withColumn("is_negative", (F.col("review_score") <= label_max_score).cast("int"))
    )


def to_timestamp_or_missing(value: Column) -> Column:
    """Date-time of a value, missing where it does not parse."""
    return value.try_cast("timestamp_ntz")


def numeric_or_missing(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; what does not parse, is not a number or is not there becomes missing."""
    casts = []
    for name in columns:
        if name in frame.columns:
            number = F.col(name).try_cast("double")
            casts.append(F.when(~F.isnan(number), number).alias(name))
        else:
            casts.append(F.lit(None).cast("double").alias(name))
    return frame.select(*[c for c in frame.columns if c not in columns], *casts)


def unfilled_features(
    tables: Tables, label_max_score: int = NEGATIVE_LABEL_MAX_SCORE
) -> DataFrame:
    """Feature matrix with missing values left in place, written once for the passes that follow."""
    frame = stage(derived_features(reviewed_orders(tables), label_max_score), "features", "zstd")
    # The codes are stored, so their true size is known and the matrix does not move for them.
    codes = stage(state_codes(frame), "state-codes")
    coded = lookup_join(
        frame, codes, "customer_state", "left", spread_by="order_id"
    ).withColumn("customer_state_code", F.coalesce("customer_state_code", F.lit(-1)))
    return numeric_or_missing(coded, FEATURE_COLUMNS).select(*KEPT_COLUMNS, *FEATURE_COLUMNS)


def fill_missing(frame: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Replace missing values per column by the given number."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if value is not None else F.col(name)
        for name, value in values.items()
    }
    return frame.select(*[filled.get(c, F.col(c)).alias(c) for c in frame.columns])


def order_features(tables: Tables, label_max_score: int = NEGATIVE_LABEL_MAX_SCORE) -> DataFrame:
    """The complete feature matrix: key columns, label, 19 features with medians filled in."""
    frame = unfilled_features(tables, label_max_score)
    return fill_missing(frame, medians(frame, FEATURE_COLUMNS))


def feature_medians(frame: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Exact median of every feature, one row per feature."""
    values = medians(frame, columns)
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("median", T.DoubleType())]
    )
    return frame.sparkSession.createDataFrame([(c, values[c]) for c in columns], schema)


def target_profile(frame: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Rows and feature means per label, with the overall negative rate."""
    counted = frame.groupBy("is_negative").agg(
        F.count("*").alias("n_rows"), *[round_half_even(F.avg(c), 2).alias(c) for c in columns]
    )
    overall = F.sum("n_rows").over(Window.partitionBy())  # two rows, one per label
    negative = F.sum(F.col("n_rows") * F.col("is_negative")).over(Window.partitionBy())
    return counted.withColumn("target_rate", (negative / overall)).orderBy("is_negative")


def standardize(
    frame: DataFrame, fitted_on: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS
) -> DataFrame:
    """Subtract the mean and divide by the population deviation of ``fitted_on``.

    A constant column is only centred.
    """
    figures = []
    for name in columns:
        figures += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_dev")]
    fit = fitted_on.agg(*figures).select(F.struct("*")).scalar()
    fitted = frame.withColumn("_fit", fit)
    scaled = {}
    for name in columns:
        deviation = F.col(f"_fit.{name}_dev")
        divisor = F.when(deviation > 0, deviation).otherwise(F.lit(1.0))
        scaled[name] = (F.col(name) - F.col(f"_fit.{name}_mean")) / divisor
    return fitted.select(*[scaled.get(c, F.col(c)).alias(c) for c in frame.columns])
