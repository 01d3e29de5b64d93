"""Marketplace analytics on PySpark: views, reports, features, seller score, text and models."""

from sellerscope.tables import Tables

__all__ = ["Tables"]
