"""Order-level and item-level views, and the per-order facts the aggregates build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import days, micros_between
from sellerscope.functions.joins import left_join_many, lookup_join
from sellerscope.settings import LOW_SCORE_MAX
from sellerscope.tables import Tables

_CUSTOMER = ["customer_unique_id", "customer_state"]
_REVIEW = ["review_score", "review_comment_message"]
_CORE = [
    "order_id",
    "customer_id",
    *_CUSTOMER,
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    *_REVIEW,
    "delivery_days",
    "days_vs_estimate",
]


def delivery_micros() -> Column:
    """Microseconds from purchase to delivery, missing while undelivered."""
    return micros_between("order_purchase_timestamp", "order_delivered_customer_date")


def margin_micros() -> Column:
    """Microseconds the delivery beat the estimate by; negative when late."""
    return micros_between("order_delivered_customer_date", "order_estimated_delivery_date")


def delivery_days() -> Column:
    return days(delivery_micros())


def days_vs_estimate() -> Column:
    return days(margin_micros())


def order_core(tables: Tables) -> DataFrame:
    """One row per (order, review), or per order without review, with the delivery facts."""
    reviewed = left_join_many(
        tables.orders.drop("order_delivered_carrier_date"),
        tables.order_reviews.select("order_id", *_REVIEW),
        "order_id",
    )
    with_customer = lookup_join(
        reviewed,
        tables.customers.select("customer_id", *_CUSTOMER),
        "customer_id",
        "left",
        spread_by="order_id",
    )
    return (
        with_customer.withColumn("delivery_days", delivery_days())
        .withColumn("days_vs_estimate", days_vs_estimate())
        .select(*_CORE)
    )


def seller_orders(tables: Tables, core: DataFrame | None = None) -> DataFrame:
    """One row per (item, review of its order), or per item without review."""
    facts = ["review_score", "delivery_days", "days_vs_estimate", "order_status"]
    items = tables.order_items.select(
        "seller_id", "order_id", "product_id", "price", "freight_value"
    )
    if core is None:
        # The customer columns are not needed, so that join is left out.
        core = left_join_many(
            tables.orders, tables.order_reviews.select("order_id", "review_score"), "order_id"
        ).select(
            "order_id",
            "review_score",
            delivery_days().alias("delivery_days"),
            days_vs_estimate().alias("days_vs_estimate"),
            "order_status",
        )
    return left_join_many(items, core.select("order_id", *facts), "order_id")


def review_facts(tables: Tables) -> DataFrame:
    """One row per reviewed order: reviews, scored reviews, score total, low scores.

    Aggregates over the item/review fan-out are sums of products of per-order totals, so the
    reports join these single rows and never build the fan-out.
    """
    score = F.col("review_score")
    return tables.order_reviews.groupBy("order_id").agg(
        F.count("*").alias("n_reviews"),
        F.count(score).alias("n_scored"),
        F.sum(score.cast("bigint")).alias("score_sum"),
        F.count_if(score <= LOW_SCORE_MAX).alias("n_low"),
    )


def order_facts(tables: Tables, how: str = "left") -> DataFrame:
    """One row per order: customer, status, delivery facts and its review totals.

    ``fan_out`` is how many rows the order has in ``order_core``.
    """
    orders = tables.orders.select(
        "order_id",
        "customer_id",
        "order_status",
        delivery_micros().alias("delivery_micros"),
        margin_micros().alias("margin_micros"),
    )
    joined = orders.join(review_facts(tables), "order_id", how)
    return joined.select(
        *orders.columns,
        F.coalesce("n_reviews", F.lit(1)).alias("fan_out"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        F.coalesce("score_sum", F.lit(0)).alias("score_sum"),
        F.coalesce("n_low", F.lit(0)).alias("n_low"),
    )
