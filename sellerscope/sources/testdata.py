"""The generated star-schema tables, mapped onto the marketplace relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerscope.tables import Tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over all cores if the scan has fewer splits than that.

    A small table may be a single row group, which one task would tokenize alone. A table with
    splits enough for every core is left where it is.
    """
    frame = read_table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy relations over the parquet files in ``sf_dir``; keys stay bigint."""
    raw_orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    nation = read_table(spark, sf_dir, "nation")

    orders = raw_orders.selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'delivered' "
        "WHEN o_orderkey % 10 < 4 THEN 'canceled' ELSE 'shipped' END AS order_status",
        "o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400) "
        "AS order_purchase_timestamp",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * "
        "(o_orderkey * 7919 % 86400 + 3600 * (o_orderkey % 49)) END AS order_approved_at",
        "CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL '1' DAY * "
        "(1 + o_orderkey % 3) END AS order_delivered_carrier_date",
        "CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 89 <> 0 THEN o_orderdate + "
        "INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400 + 86400 * (3 + o_orderkey * 13 % 31) "
        "+ o_orderkey * 31 % 7200) END AS order_delivered_customer_date",
        "o_orderdate + INTERVAL '1' DAY * (10 + o_orderkey % 30) AS order_estimated_delivery_date",
    )
    order_items = lineitem.selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "l_suppkey * 50 + l_partkey % 50 AS seller_id",
        "l_shipdate AS shipping_limit_date",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS price",
        "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value",
    )
    payments = raw_orders.selectExpr(
        "o_orderkey AS order_id",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value",
        "CAST(1 + o_orderkey % 10 AS INT) AS payment_installments",
    ).unionByName(
        raw_orders.filter("o_orderkey % 5 = 0").selectExpr(
            "o_orderkey AS order_id",
            "CAST(10 AS DECIMAL(12,2)) AS payment_value",
            "CAST(1 + (o_orderkey + 3) % 10 AS INT) AS payment_installments",
        )
    )
    # Every 50th order gets a second review.
    copies = F.when(F.col("order_id") % 50 == 1, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    reviews = (
        orders.filter("order_id % 11 <> 0")
        .withColumn("k", F.explode(copies))
        .withColumn(
            "late",
            F.expr("coalesce(order_delivered_customer_date > order_estimated_delivery_date, false)"),
        )
        .withColumn(
            "review_score",
            F.expr(
                "CAST(CASE WHEN late AND order_id % 10 < 7 THEN 1 + (order_id + k) % 2 "
                "WHEN (order_id * 7 + k) % 10 < 1 THEN 3 "
                "WHEN (order_id * 7 + k) % 10 < 2 THEN 1 + order_id % 2 "
                "ELSE 4 + (order_id + k) % 2 END AS INT)"
            ),
        )
        .selectExpr(
            "order_id * 10 + k AS review_id",
            "order_id",
            "review_score",
            "CASE WHEN order_id % 13 = 0 THEN NULL WHEN order_id % 13 = 1 THEN '  ' ELSE concat("
            "CASE review_score WHEN 1 THEN 'péssimo, não recomendo' WHEN 2 THEN 'produto com defeito' "
            "WHEN 3 THEN 'chegou' WHEN 4 THEN 'bom produto' ELSE 'excelente, recomendo' END, "
            "CASE order_id % 7 WHEN 0 THEN ' entrega atrasada' WHEN 1 THEN ' entrega rápida' "
            "WHEN 2 THEN ' não gostei' ELSE '' END) END AS review_comment_message",
            "order_purchase_timestamp + INTERVAL '1' DAY * (50 + k) AS review_creation_date",
            "order_purchase_timestamp + INTERVAL '1' DAY * (60 + k) AS review_answer_timestamp",
        )
    )
    customers = (
        read_table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .selectExpr(
            "c_custkey AS customer_id",
            "c_custkey - c_custkey % 3 % 2 AS customer_unique_id",
            "CASE WHEN c_custkey % 101 <> 0 THEN n_name END AS customer_state",
        )
    )
    supplier_state = read_table(spark, sf_dir, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    sellers = (
        lineitem.selectExpr("l_suppkey", "l_suppkey * 50 + l_partkey % 50 AS seller_id")
        .distinct()
        .join(supplier_state, F.col("l_suppkey") == F.col("s_suppkey"))
        .selectExpr("seller_id", "n_name AS seller_state")
    )
    part = read_table(spark, sf_dir, "part")
    products = part.selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS product_category_name",
        "CAST(length(p_name) * 20 AS DOUBLE) AS product_description_lenght",
        "CAST(p_partkey % 6 + 1 AS DOUBLE) AS product_photos_qty",
        "CAST(CASE WHEN p_partkey % 53 <> 0 THEN p_size * 100 END AS DOUBLE) AS product_weight_g",
        "CAST(p_size AS DOUBLE) AS product_length_cm",
        "CAST(p_partkey % 20 + 2 AS DOUBLE) AS product_height_cm",
        "CAST(p_partkey % 15 + 5 AS DOUBLE) AS product_width_cm",
    )
    # PROMO has no English name on purpose.
    translation = (
        part.filter("p_type <> 'PROMO'")
        .selectExpr(
            "p_type AS product_category_name",
            "concat(lower(p_type), '_goods') AS product_category_name_english",
        )
        .distinct()
    )
    return Tables(
        orders=orders,
        order_items=order_items,
        order_payments=payments,
        order_reviews=reviews,
        customers=customers,
        products=products,
        sellers=sellers,
        category_translation=translation,
    )
