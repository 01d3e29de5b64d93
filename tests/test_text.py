import math
from collections import Counter

import pyarrow as pa
import pytest
from helpers import review, rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sellerscope.operators import text
from sellerscope.session import stage


def labelled(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r["text"]: r for r in rows(text.lexicon_labels(frame))}


def test_polarity(spark):
    good, bad = "produto excelente, recomendo, amei", "péssimo, horrível, não recomendo"
    found = labelled(spark, good, bad, "produto excelente recomendo", "produto péssimo horrível")
    assert found[good]["lexicon_score"] > 0 > found[bad]["lexicon_score"]
    assert found["produto excelente recomendo"]["lexicon_sentiment"] == "positive"
    assert found["produto péssimo horrível"]["lexicon_sentiment"] == "negative"


def test_negation(spark):
    found = labelled(spark, "não recomendo", "nem ruim", "NÃO GOSTEI")
    assert found["não recomendo"]["lexicon_score"] == pytest.approx(-1.0)  # (-1 - 1) / sqrt(2), clipped
    assert found["nem ruim"]["lexicon_score"] == pytest.approx(1 / math.sqrt(2))
    assert found["NÃO GOSTEI"]["lexicon_score"] == pytest.approx(-1.0)


def test_texts_without_words_are_neutral(spark):
    found = labelled(spark, "", None, "123 !!")
    assert {(r["lexicon_score"], r["lexicon_sentiment"]) for r in found.values()} == {(0.0, "neutral")}


def test_long_text_is_scored_whole(spark):
    long = "palavra " * 20_000 + "excelente"
    (row,) = labelled(spark, long).values()
    assert row["lexicon_score"] == pytest.approx(1 / math.sqrt(20_001))


def test_reviews_with_text_leave_out_blank_ones(make):
    t = make(order_reviews=[review("a", 5, "bom"), review("b", 1, "   "), review("c", 1, None)])
    assert [r["text"] for r in rows(text.reviews_with_text(t))] == ["bom"]


def test_lexicon_eval(make):
    t = make(
        order_reviews=[
            review("a", 1, "péssimo"), review("b", 2, "bom"), review("c", 5, "ruim"), review("d", 5, "amei")
        ]
    )
    (found,) = rows(text.lexicon_eval(text.reviews_with_text(t)))
    assert found == {"lexicon_accuracy": 0.5, "lexicon_f1_negative": 0.5}


def test_tfidf_against_the_formula(spark):
    texts = ["Uma casa, uma rua!", "casa casa verde", "rua verde é x1", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = [["uma", "casa", "uma", "rua"], ["casa", "casa", "verde"], ["rua", "verde", "x1"], [], []]
    terms = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in words]
    df = Counter(t for counted in terms for t in counted)
    kept = sorted(t for t in df if df[t] >= 2)
    found = rows(text.tfidf(frame, "id", min_df=2))
    expected = {}
    for i, counted in enumerate(terms):
        raw = {
            t: (1 + math.log(counted[t])) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
            for t in counted if t in kept
        }
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected.update({(i, t): v / norm for t, v in raw.items()})
    assert {(r["id"], r["term"]) for r in found} == set(expected)
    assert all(r["tfidf"] == pytest.approx(expected[r["id"], r["term"]]) for r in found)
    assert all(kept[r["term_index"]] == r["term"] for r in found)


def test_tfidf_moves_no_words(spark):
    frame = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (1, "bb bb"), (None, "aa")], "id bigint, text string")
    vocabulary = stage(text.tfidf_vocabulary(frame, min_df=1), "vocabulary")
    found = text.tfidf(frame, "id", vocabulary=vocabulary)
    shuffles = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1  # by the id alone: counts, then norms
    assert {(r["id"], r["term"]): r["tf"] for r in rows(found) if " " not in r["term"]} == {
        (1, "aa"): 1, (1, "bb"): 3, (2, "aa"): 1, (2, "cc"): 1, (None, "aa"): 1
    }


def test_vocabulary_keeps_the_most_frequent_terms(spark):
    frame = spark.createDataFrame([("aa aa aa bb cc",), ("aa bb cc bb",)], "text string")
    kept = [r["term"] for r in rows(text.tfidf_vocabulary(frame, min_df=2, max_terms=2))]
    assert kept == ["aa", "bb"]
    every = [r["term"] for r in rows(text.tfidf_vocabulary(frame, min_df=2))]
    assert every == ["aa", "aa bb", "bb", "bb cc", "cc"]


def test_classifier_learns_and_names_its_terms(spark):
    texts = ["produto ruim quebrado", "muito bom produto", "ruim demais", "bom e barato"] * 25
    frame = spark.createDataFrame(
        [(i, int("ruim" in t), t) for i, t in enumerate(texts)], "id bigint, label int, text string"
    )
    model, metrics, vocabulary = text.train_text_classifier(frame, "id", max_iter=50)
    assert metrics.first()["accuracy"] == 1.0
    named = rows(text.term_polarity(model, vocabulary, 1))
    assert {r["polarity"]: r["term"] for r in named}["negative"] == "ruim"
    assert {r["polarity"]: r["term"] for r in named}["positive"] == "bom"
    empty = text.tfidf_vectors(
        frame.limit(1).withColumn("text", F.lit("zz")), "id", "text", vocabulary, vocabulary.count()
    )
    assert empty.first()["features"].numNonzeros() == 0


def test_classifier_learns_once_the_session_has_observed_a_figure(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    test_classifier_learns_and_names_its_terms(spark)


def test_vocabulary_totals_a_batch_before_the_grouping():
    rows = pa.array([["a", "b", "a"], [], ["b", "c"], ["a"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([rows], ["terms"])
    empty = batch.slice(1, 1)
    found = [r for b in text._batch_totals(iter([batch, empty, batch.slice(2)])) for r in b.to_pylist()]
    assert sorted(tuple(r.values()) for r in found) == [
        ("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("c", 1, 1),
    ]


def test_vocabulary_of_missing_and_repeated_texts(spark):
    frame = spark.createDataFrame([("ab cd ab cd",), (None,), ("",), ("cd ab",), ("cd ab",)], "text string")
    found = [tuple(r) for r in text.tfidf_vocabulary(frame, min_df=2).orderBy("term").collect()]
    assert found == [("ab", 0, 4, 3), ("cd", 1, 4, 3), ("cd ab", 2, 3, 3)]


def words_of(rows):
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["words"])


def test_terms_are_totalled_some_words_at_a_time(monkeypatch):
    """Few words are held at once, whatever the batch; runs end between rows, and pairs do not reach over them."""
    rows = [["a", "b", "a", "b"], [], ["b"], ["a", "b"], ["c", "c", "c"], []]
    batches = [words_of(rows).slice(1), words_of(rows).slice(0, 1), words_of([]), words_of([[], []])]
    expected = {"a": (3, 2), "b": (4, 3), "c": (3, 1), "a b": (3, 2), "b a": (1, 1), "c c": (2, 1)}
    for most, n_runs in ((1 << 20, 4), (3, 6), (1, 8)):
        monkeypatch.setattr(text, "WORDS_AT_ONCE", most)
        found, runs = {}, 0
        for batch in text._batch_totals(iter(batches), pairs=True):
            runs += 1
            for term, tf, df in zip(*(c.to_pylist() for c in batch.columns)):
                before = found.get(term, (0, 0))
                found[term] = (before[0] + tf, before[1] + df)
        assert found == expected
        assert runs >= n_runs
