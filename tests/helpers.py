"""Rows and paths that several tests use."""

from datetime import datetime, timedelta
from decimal import Decimal

SMALL = "/root/testdata/sf0.001"
PURCHASE = datetime(2018, 1, 1)


def order(order_id, customer="c1", status="delivered", delivered=10.0, margin=0.0, purchase=PURCHASE):
    """An order delivered after some days, with the estimate ``margin`` days later."""
    arrival = None if delivered is None else purchase + timedelta(days=delivered)
    estimate = purchase + timedelta(days=(delivered or 10.0) + margin)
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": purchase,
        "order_approved_at": purchase + timedelta(hours=2),
        "order_delivered_customer_date": arrival,
        "order_estimated_delivery_date": estimate,
    }


def item(order_id, seller="s1", product="p1", price="10.00", freight="1.00"):
    return {
        "order_id": order_id,
        "product_id": product,
        "seller_id": seller,
        "price": Decimal(price),
        "freight_value": Decimal(freight),
    }


def review(order_id, score, text=None, days=20):
    return {
        "order_id": order_id,
        "review_score": score,
        "review_comment_message": text,
        "review_answer_timestamp": PURCHASE + timedelta(days=days),
    }


def rows(df):
    return [r.asDict() for r in df.collect()]
