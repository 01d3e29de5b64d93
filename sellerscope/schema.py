"""Declared column types per relation (nothing is inferred from data)."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()
_TS, _MONEY = T.TimestampNTZType(), T.DecimalType(12, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "orders": _struct(
        order_id=_STR,
        customer_id=_STR,
        order_status=_STR,
        order_purchase_timestamp=_TS,
        order_approved_at=_TS,
        order_delivered_carrier_date=_TS,
        order_delivered_customer_date=_TS,
        order_estimated_delivery_date=_TS,
    ),
    "order_items": _struct(
        order_id=_STR,
        product_id=_STR,
        seller_id=_STR,
        shipping_limit_date=_TS,
        price=_MONEY,
        freight_value=_MONEY,
    ),
    "order_payments": _struct(order_id=_STR, payment_value=_MONEY, payment_installments=_INT),
    "order_reviews": _struct(
        order_id=_STR,
        review_score=_INT,
        review_comment_message=_STR,
        review_creation_date=_TS,
        review_answer_timestamp=_TS,
    ),
    "customers": _struct(customer_id=_STR, customer_unique_id=_STR, customer_state=_STR),
    "products": _struct(
        product_id=_STR,
        product_category_name=_STR,
        product_description_lenght=_DBL,
        product_photos_qty=_DBL,
        product_weight_g=_DBL,
        product_length_cm=_DBL,
        product_height_cm=_DBL,
        product_width_cm=_DBL,
    ),
    "sellers": _struct(seller_id=_STR, seller_state=_STR),
    "category_translation": _struct(
        product_category_name=_STR, product_category_name_english=_STR
    ),
    # No query reads it: it is loaded as it stands, all columns text.
    "geolocation": T.StructType([]),
}

METRICS_SCHEMA = _struct(model=_STR, roc_auc=_DBL, pr_auc=_DBL, f1=_DBL, accuracy=_DBL)
IMPORTANCE_SCHEMA = _struct(feature=_STR, mean_abs_shap=_DBL)
