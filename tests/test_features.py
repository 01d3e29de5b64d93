import math
from decimal import Decimal

import pytest
from helpers import item, order, review, rows
from pyspark.sql import functions as F

from sellerscope.operators import features
from sellerscope.session import stage
from sellerscope.settings import FEATURE_COLUMNS


def test_matrix_is_complete(generated):
    frame = stage(features.order_features(generated), "t")
    assert frame.columns == features.KEPT_COLUMNS + FEATURE_COLUMNS
    assert {r[0] for r in frame.select("is_negative").distinct().collect()} == {0, 1}
    gaps = frame.select([F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in FEATURE_COLUMNS])
    assert set(gaps.first().asDict().values()) == {0}
    assert frame.count() > 900


def test_values_of_a_small_market(make):
    t = make(
        orders=[order("o1", customer="c1", delivered=4.0, margin=1.0), order("o2", customer="c2")],
        order_items=[
            item("o1", seller="s1", product="p1", price="10.00", freight="2.00"),
            item("o1", seller="s2", product="p2", price="30.00", freight="2.00"),
            item("o2", seller="s1", product="p1", price="0.00", freight="5.00"),
        ],
        order_reviews=[review("o1", 3), review("o2", 4)],
        order_payments=[
            {"order_id": "o1", "payment_value": Decimal(44), "payment_installments": 3},
            {"order_id": "o1", "payment_value": Decimal(1), "payment_installments": 2},
        ],
        customers=[{"customer_id": "c1", "customer_state": "SP"}, {"customer_id": "c2"}],
        products=[
            {
                "product_id": "p1", "product_category_name": "toys", "product_weight_g": 100.0,
                "product_length_cm": 2.0, "product_height_cm": 3.0, "product_width_cm": 4.0,
            },
            {"product_id": "p2", "product_weight_g": 300.0},
        ],
    )
    found = {r["order_id"]: r for r in rows(features.unfilled_features(t))}
    one, two = found["o1"], found["o2"]
    assert (one["is_negative"], two["is_negative"]) == (1, 0)
    assert (one["price_total"], one["freight_total"], one["freight_ratio"]) == (40.0, 4.0, 0.1)
    assert (one["n_items"], one["n_sellers"], one["n_categories"]) == (2.0, 2.0, 1.0)
    assert (one["product_weight_g"], one["product_volume_cm3"]) == (200.0, 24.0)
    assert (one["payment_value"], one["payment_installments"]) == (45.0, 3.0)
    assert (one["delivery_days"], one["estimated_delivery_days"]) == (4.0, 5.0)
    assert one["approval_delay_hours"] == 2.0
    assert (one["purchase_dow"], one["purchase_month"]) == (0.0, 1.0)  # 2018-01-01 is a Monday
    # s1 has scores 3 and 4, s2 has score 3.
    assert one["seller_avg_review_hist"] == pytest.approx((3.5 + 3.0) / 2)
    assert (one["customer_state_code"], two["customer_state_code"]) == (0.0, -1.0)
    assert two["freight_ratio"] is None and two["payment_value"] is None
    filled = {r["order_id"]: r for r in rows(features.order_features(t))}
    assert filled["o2"]["freight_ratio"] == 0.1 and filled["o2"]["payment_value"] == 45.0
    assert filled["o2"]["customer_state_code"] == -1.0


def test_history_leaves_out_orders_without_reviewed_sellers(make):
    t = make(
        orders=[order("o1"), order("o2")],
        order_items=[item("o1", seller="s1"), item("o2", seller="s2")],
        order_reviews=[review("o1", 5)],
    )
    assert rows(features.seller_history(t)) == [{"order_id": "o1", "seller_avg_review_hist": 5.0}]


def test_order_without_items_has_no_features(make):
    t = make(orders=[order("o1")], order_reviews=[review("o1", 5)])
    assert features.unfilled_features(t).count() == 0


def test_coercion(spark):
    frame = spark.createDataFrame([("1.5", "x"), ("NaN", "2"), (None, "")], "a string, b string")
    found = features.numeric_or_missing(frame, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in found] == [(1.5, None, None), (None, 2.0, None), (None, None, None)]
    when = frame.select(features.to_timestamp_or_missing(F.col("a")).alias("t"))
    assert when.filter("t IS NOT NULL").count() == 0


def test_standardize_uses_the_population_deviation_of_the_fitted_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    assert tuple(features.standardize(test, train, ["a", "b"]).first()) == (3.0, 1.0)


def test_profile_and_medians(generated):
    frame = stage(features.order_features(generated), "t")
    profile = rows(features.target_profile(frame))
    total = sum(r["n_rows"] for r in profile)
    assert profile[0]["target_rate"] == pytest.approx(profile[1]["n_rows"] / total)
    middles = {r["feature"]: r["median"] for r in rows(features.feature_medians(frame))}
    builtin = frame.agg(*[F.median(c).alias(c) for c in FEATURE_COLUMNS]).first().asDict()
    assert middles == builtin and not any(math.isnan(v) for v in middles.values())
