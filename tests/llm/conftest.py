import pytest
from pyspark.sql import Row

from sellerscope.session import stage


@pytest.fixture
def staged():
    return stage


@pytest.fixture
def documents(spark):
    """A documents table of (id, text, lang) rows with an extra column of a clashing name."""

    def build(rows, lang="en"):
        full = [Row(doc_id=i, text=t, lang=lang, kept="x", n_words=-1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, kept string, n_words int").repartition(3)

    return build


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (None, "no id"), (6, "é日本 ͸ <|endoftext|>")]


@pytest.fixture
def edge_rows():
    """Nulls, empty and blank texts, equal texts, a repeated row, a missing id and rare characters."""
    return list(EDGES)
