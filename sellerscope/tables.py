"""The nine relations every operator works on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tables:
    """Lazy frames, one per relation.

    Contract: ``orders.order_id``, ``customers.customer_id``, ``products.product_id`` and
    ``sellers.seller_id`` identify a row. Items, payments and reviews may repeat an order.
    """

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    products: DataFrame
    sellers: DataFrame
    category_translation: DataFrame
    geolocation: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        pairs = [(f.name, getattr(self, f.name)) for f in fields(self)]
        return [(name, frame) for name, frame in pairs if frame is not None]

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession
