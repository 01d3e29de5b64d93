import pytest
from helpers import item, order, review, rows
from pyspark.sql import functions as F

from sellerscope.operators import seller_score as seller
from sellerscope.settings import SCORE_GRADES, SCORE_WEIGHTS


def sold(seller_id, n=5, score=5, margin=1.0, delivered=10.0, status="delivered"):
    ids = [f"{seller_id}-{i}" for i in range(n)]
    return (
        [order(i, margin=margin, delivered=delivered, status=status) for i in ids],
        [item(i, seller=seller_id) for i in ids],
        [] if score is None else [review(i, score) for i in ids],
    )


def market(make, *sellers):
    orders, items, reviews = (sum(part, []) for part in zip(*sellers))
    return make(orders=orders, order_items=items, order_reviews=reviews)


def test_weights_add_up_to_one():
    assert abs(sum(SCORE_WEIGHTS.values()) - 1.0) < 1e-6


def test_weights_are_checked(make):
    with pytest.raises(ValueError):
        seller.seller_trust_scores(make(), weights={"avg_review_score": 0.5})


def test_sellers_with_few_orders_or_no_review_are_dropped_before_scaling(make):
    t = market(
        make,
        sold("a", margin=2.0),
        sold("few", n=4, margin=9.0),
        sold("silent", score=None, margin=15.0),
        sold("b", margin=1.0, n=6),
    )
    found = {r["seller_id"]: r for r in rows(seller.seller_trust_scores(t))}
    assert set(found) == {"a", "b"}
    assert found["a"]["c_delivery_speed"] == 1.0 and found["b"]["c_delivery_speed"] == 0.0


def test_never_delivered_seller_gets_the_smallest_margin(make):
    t = market(make, sold("a", margin=4.0), sold("b", margin=-3.0), sold("c", delivered=None))
    found = {r["seller_id"]: r for r in rows(seller.seller_trust_scores(t))}
    assert found["c"]["c_delivery_speed"] == found["b"]["c_delivery_speed"] == 0.0
    assert found["c"]["c_on_time_delivery_rate"] == 0.0


def test_single_seller_has_no_spread(make):
    (one,) = rows(seller.seller_trust_scores(market(make, sold("a"))))
    assert one["c_delivery_speed"] == 0.0 and one["c_order_volume"] == 0.0
    assert one["trust_score"] == 75.0  # 30 + 25 + 15 + 5
    assert one["trust_grade"] == "B — Trusted"


def test_one_review_per_order_the_last_answered(make):
    orders, items, _ = sold("a")
    reviews = [review(o["order_id"], 5) for o in orders]
    reviews.append(review("a-0", 1, days=40))
    t = make(orders=orders, order_items=items + [item("a-1", seller="a")], order_reviews=reviews)
    (stats,) = rows(seller.seller_stats(t))
    assert stats["n_orders"] == 5
    assert stats["avg_review_score"] == pytest.approx(21 / 5)
    assert stats["complaint_rate"] == pytest.approx(0.2)


def test_grade_edges(spark):
    values = [(80.0, "A"), (79.994, "B"), (65.0, "B"), (50.0, "C"), (35.0, "D"), (0.0, "F")]
    frame = spark.createDataFrame(values, "score double, expected string")
    graded = frame.withColumn("grade", seller.grade_of(F.col("score")))
    assert all(r["grade"][0] == r["expected"] for r in graded.collect())


def test_scores_in_range_and_contributions_add_up(generated):
    scores = seller.seller_trust_scores(generated).persist()
    assert scores.filter("trust_score IS NULL OR trust_score NOT BETWEEN 0 AND 100").count() == 0
    summed = seller.trust_breakdown(scores).groupBy("seller_id").agg(F.sum("contribution").alias("s"))
    gap = scores.join(summed, "seller_id").agg(F.max(F.abs(F.col("s") - F.col("trust_score"))))
    assert gap.first()[0] < 0.05
    counts = {r["trust_grade"]: r["n_sellers"] for r in rows(seller.grade_counts(scores))}
    assert list(counts) == [label for _, label in SCORE_GRADES]
    assert sum(counts.values()) == scores.count()
    assert seller.trust_histogram(scores).agg(F.sum("n_sellers")).first()[0] == scores.count()
    assert seller.sellers_of_grade(scores, rows=7).count() == 7
    scores.unpersist()
