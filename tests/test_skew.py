"""Reports on tables where a third of the rows share one key, against the plain fan-out."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from sellerscope.operators import features
from sellerscope.plans import reports

DAY = 86_400


def plain_rows(tables):
    """Key, count, mean score and, for some, revenue of every report, over the fan-out as it stands."""
    seconds = F.timestamp_diff("SECOND", F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date"))
    reviewed = tables.orders.withColumn("early", seconds).join(
        tables.order_reviews.select("order_id", "review_score"), "order_id", "left"
    )
    mean = F.round(F.avg("review_score"), 3)
    money = F.round(F.sum("price"), 2).cast("double")
    orders = F.count_distinct("order_id").alias("n")
    bucket = F.when(F.col("early") < -5 * DAY, 4).when(F.col("early") < 0, 3).when(F.col("early") < 5 * DAY, 2).otherwise(1)
    sold = tables.order_items.select("order_id", "seller_id", "product_id", "price").join(reviewed, "order_id", "left")
    names = tables.products.join(tables.category_translation, "product_category_name", "left").select(
        "product_id", F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown")).alias("category")
    )
    return {
        "delivery_vs_satisfaction": reviewed.dropna(subset=["review_score", "early"])
        .groupBy(bucket.alias("k"))
        .agg(F.count("*").alias("n"), mean),
        "top_categories": sold.join(names, "product_id").groupBy("category").agg(orders, money, mean).filter("n >= 100"),
        "state_performance": reviewed.join(tables.customers, "customer_id").groupBy("customer_state").agg(orders, mean),
        "seller_leaderboard": sold.dropna(subset=["review_score"]).groupBy("seller_id").agg(orders, mean, money).filter("n >= 10"),
    }


COLUMNS = {
    "delivery_vs_satisfaction": ["cast(left(delivery_bucket, 1) AS int)", "n_orders", "avg_review_score"],
    "top_categories": ["category", "orders", "revenue", "avg_review_score"],
    "state_performance": ["state", "orders", "avg_review_score"],
    "seller_leaderboard": ["seller_id", "n_orders", "avg_review_score", "revenue"],
}


@pytest.fixture(params=["10485760b", "-1"], ids=["broadcast", "shuffled"])
def skewed(request, spark, generated):
    third = F.col("order_id") % 3
    items = generated.order_items.withColumns(
        {
            "seller_id": F.when(third == 0, 7).otherwise(F.col("seller_id")),
            "product_id": F.when(third == 1, 5).otherwise(F.col("product_id")),
        }
    )
    reviews = generated.order_reviews.withColumn(
        "order_id", F.when(F.col("review_id") % 3 == 0, 9).otherwise(F.col("order_id"))
    )
    orders = generated.orders.withColumn(
        "customer_id", F.when(third == 2, 3).when(third == 1, None).otherwise(F.col("customer_id"))
    )
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield dataclasses.replace(generated, order_items=items, order_reviews=reviews, orders=orders)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_reports_equal_the_plain_fan_out(skewed):
    for name, expected in plain_rows(skewed).items():
        found = {tuple(r) for r in reports.run_report(skewed, name).selectExpr(*COLUMNS[name]).collect()}
        assert found == {tuple(r) for r in expected.collect()}, name
        assert found, name


def test_features_keep_every_review(skewed):
    frame = features.unfilled_features(skewed)
    delivered = skewed.orders.filter("order_status = 'delivered'").join(
        skewed.order_items.select("order_id").distinct(), "order_id"
    )
    assert frame.count() == delivered.join(skewed.order_reviews, "order_id").count()
    hot = frame.filter("order_id = 9")
    assert hot.count() > 300 and hot.select("seller_avg_review_hist").distinct().count() == 1
