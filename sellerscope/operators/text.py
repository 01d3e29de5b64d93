"""Lexicon sentiment, TF-IDF and the supervised text classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sellerscope.functions.expressions import bind, round_half_even
from sellerscope.operators.metrics import binary_metrics, evaluate
from sellerscope.operators.splits import seeded_sample, stratified_split, with_balanced_weight
from sellerscope.session import stage
from sellerscope.settings import (
    LOW_SCORE_MAX,
    NEGATIVE_WORDS,
    NEGATOR_WORDS,
    POLARITY_MARGIN,
    POSITIVE_WORDS,
    RANDOM_SEED,
    WORD_PATTERN,
)
from sellerscope.sources.artifacts import stage_model
from sellerscope.tables import Tables

# A term is a run of two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Words whose terms are totalled at once: bounds the memory of a task.
WORDS_AT_ONCE = 1 << 20


# --- lexicon ------------------------------------------------------------------------------------


def reviews_with_text(tables: Tables, *keep: str) -> DataFrame:
    """Score and text of the reviews whose text is neither missing nor blank."""
    text = F.col("review_comment_message")
    return tables.order_reviews.filter(text.isNotNull() & (F.trim(text) != "")).select(
        *keep, "review_score", text.alias("text")
    )


def words(text: Column) -> Column:
    """Lower-cased letter runs; none for missing text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)


def with_words(frame: DataFrame, text: str = "text") -> DataFrame:
    return frame.withColumn("tokens", words(F.col(text)))


def lexicon_scores(
    frame: DataFrame,
    text: str = "text",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    negators: Sequence[str] = NEGATOR_WORDS,
) -> DataFrame:
    """Add ``lexicon_score`` in [-1, 1].

    Polarity words count +1 or -1, reversed after a negator; the total is divided by the root of
    the number of words.
    """

    def polarity(tokens: Column, word: Column, place: Column) -> Column:
        value = F.when(word.isin(*positive), 1).when(word.isin(*negative), -1).otherwise(0)
        turned = F.get(tokens, place - 1).isin(*negators)
        return F.when(turned, -value).otherwise(value)

    def score(tokens: Column) -> Column:
        values = F.transform(tokens, lambda word, place: polarity(tokens, word, place))
        total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
        length = F.size(tokens)
        return F.when(length > 0, total / F.sqrt(length.cast("double"))).otherwise(F.lit(0.0))

    # Never missing, so limited without naming it twice: the text is scored once.
    found = bind(words(F.col(text)), score)
    return frame.withColumn("lexicon_score", F.least(F.greatest(found, F.lit(-1.0)), F.lit(1.0)))


def lexicon_labels(frame: DataFrame, text: str = "text", margin: float = POLARITY_MARGIN) -> DataFrame:
    """Add ``lexicon_score`` and ``lexicon_sentiment``: positive, negative or neutral."""
    score = F.col("lexicon_score")
    return lexicon_scores(frame, text).withColumn(
        "lexicon_sentiment",
        F.when(score > margin, "positive").when(score < -margin, "negative").otherwise("neutral"),
    )


def lexicon_eval(reviews: DataFrame, low_score_max: int = LOW_SCORE_MAX) -> DataFrame:
    """Agreement of negative lexicon scores with low star ratings."""
    predicted = lexicon_scores(reviews).select(
        _low(low_score_max).alias("label"),
        (F.col("lexicon_score") < -POLARITY_MARGIN).cast("int").alias("prediction"),
    )
    return binary_metrics(predicted).select(
        round_half_even(F.col("accuracy"), 4).alias("lexicon_accuracy"),
        round_half_even(F.col("f1"), 4).alias("lexicon_f1_negative"),
    )


def labelled_sample(
    reviews: DataFrame, row_id: str, size: int = 5000, seed: int = RANDOM_SEED
) -> DataFrame:
    """A seeded sample of reviews with their lexicon label."""
    return lexicon_labels(seeded_sample(reviews, row_id, size, seed))


def sentiment_mix(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("lexicon_sentiment").agg(F.count("*").alias("n"))


def text_reviews_by_score(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("review_score").agg(F.count("text").alias("n")).orderBy("review_score")


def _low(low_score_max: int) -> Column:
    return F.coalesce((F.col("review_score") <= low_score_max).cast("int"), F.lit(0))


# --- TF-IDF -------------------------------------------------------------------------------------


def _single_terms(text: str) -> Column:
    """The single words of a text, in order."""
    plain = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.regexp_extract_all(plain, F.lit(TERM_PATTERN), 0)


def _terms(text: str) -> Column:
    """The single words of a text and the pairs of neighbouring words, in one array."""

    def with_pairs(single: Column) -> Column:
        pairs = F.transform(single, lambda w, i: F.concat(w, F.lit(" "), F.get(single, i + 1)))
        return F.concat(single, F.filter(pairs, lambda p: p.isNotNull()))

    return bind(_single_terms(text), with_pairs)


def _rows_at_once(words: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of rows with about ``WORDS_AT_ONCE`` words, a longer row by itself."""
    ends, at = words.offsets.to_numpy()[1:].astype(np.int64), 0
    while at < len(words):
        start = ends[at - 1] if at else words.offsets[0].as_py()
        n = max(int(np.searchsorted(ends, start + WORDS_AT_ONCE, "right")) - at, 1)
        yield words.slice(at, n)
        at += n


def _totals(code: np.ndarray, row: np.ndarray, size: int) -> list[pa.Array]:
    """Occurrences and rows of each of ``size`` codes."""
    once = np.unique(row * size + code) % max(size, 1)  # no rows, no size
    return [pa.array(np.bincount(found, minlength=size)) for found in (code, once)]


def _batch_totals(batches: Iterator[pa.RecordBatch], pairs: bool = False) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows of each term within some rows, given the terms of every row; if asked for, of neighbouring pairs too.

    Pairs are pairs of numbers; only the distinct ones are put into words.
    """
    names = ["term", "tf", "df"]
    for terms in (run for batch in batches for run in _rows_at_once(batch.column(0))):
        coded = terms.flatten().dictionary_encode()
        known, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
        if not len(known):
            continue
        row = pc.list_parent_indices(terms).to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([known, *_totals(code, row, len(known))], names)
        if pairs:
            near = row[1:] == row[:-1]
            coded = pa.array((code[:-1] * len(known) + code[1:])[near]).dictionary_encode()
            first, second = (known.take(pa.array(x)) for x in np.divmod(coded.dictionary.to_numpy(), len(known)))
            code = coded.indices.to_numpy().astype(np.int64)
            joined = pc.binary_join_element_wise(first, second, " ")
            yield pa.RecordBatch.from_arrays([joined, *_totals(code, row[:-1][near], len(joined))], names)


def tfidf_vocabulary(
    frame: DataFrame, text: str = "text", min_df: int = 5, max_terms: int = 20_000
) -> DataFrame:
    """Most frequent terms found in at least ``min_df`` rows, numbered in sorted order.

    Occurrences and rows per term are totalled for some rows at a time first, so a term of many rows reaches the grouping by
    term once for each such run; the grouping combines before the shuffle. Tasks are sent single words only, pairs are made there.
    """
    counted = (
        frame.select(_single_terms(text).alias("words"))
        .mapInArrow(partial(_batch_totals, pairs=True), "term string, tf bigint, df bigint")
        .groupBy("term")
        .agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
        .filter(F.col("df") >= min_df)
    )
    kept = counted.orderBy(F.desc("total"), "term").limit(max_terms)
    # At most max_terms rows are numbered here.
    index = (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
    return kept.select("term", index.alias("term_index"), "total", "df")


def tfidf(
    frame: DataFrame,
    row_id: str,
    text: str = "text",
    min_df: int = 5,
    max_terms: int = 20_000,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """One row per (row, vocabulary term): sublinear term weight, smoothed idf, unit length.

    Only the places of vocabulary terms are shuffled, once: the vocabulary has at most ``max_terms`` rows, so it is
    broadcast to the exploded terms, and its words are put back behind the shuffle. Rows stay where their id is dealt
    for the counts and the norm. A row keeps at most ``max_terms`` terms for its norm.
    """
    if vocabulary is None:
        vocabulary = stage(tfidf_vocabulary(frame, text, min_df, max_terms), "vocabulary")
    rows = frame.select(F.count("*")).scalar()
    idf = F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("df"))) + 1.0
    names, weights = vocabulary.select("term_index", "term"), vocabulary.select("term_index", idf.alias("idf"))
    places = (
        frame.select(row_id, F.explode_outer(_terms(text)).alias("term"))
        .join(F.broadcast(names), "term")
        .select(row_id, "term_index")
    )
    # Dealt by the id alone, which is enough for the grouping and the window behind it.
    counted = places.repartition(row_id).groupBy(row_id, "term_index").agg(F.count("*").alias("tf"))
    raw = counted.join(F.broadcast(weights), "term_index").withColumn(
        "raw", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(row_id)))
    scaled = raw.select(row_id, "term_index", "tf", (F.col("raw") / length).alias("tfidf"))
    return scaled.join(F.broadcast(names), "term_index").select(row_id, "term", "term_index", "tf", "tfidf")


@F.udf(VectorUDT())
def _sparse(size, indices, values):
    return Vectors.sparse(size, indices or [], values or [])


def tfidf_vectors(
    frame: DataFrame, row_id: str, text: str, vocabulary: DataFrame, size: int
) -> DataFrame:
    """``frame`` with a sparse ``features`` vector per row, empty if no term is known."""
    entries = F.sort_array(F.collect_list(F.struct("term_index", "tfidf")))  # at most size entries
    per_row = (
        tfidf(frame, row_id, text, vocabulary=vocabulary)
        .groupBy(row_id)
        .agg(entries.alias("entries"))
    )
    vector = _sparse(F.lit(size), F.col("entries.term_index"), F.col("entries.tfidf"))
    return frame.join(per_row, row_id, "left").withColumn("features", vector).drop("entries")


def train_text_classifier(
    labelled: DataFrame,
    row_id: str,
    text: str = "text",
    min_df: int = 5,
    max_terms: int = 20_000,
    c: float = 4.0,
    max_iter: int = 2000,
    seed: int = RANDOM_SEED,
) -> tuple[LogisticRegressionModel, DataFrame, DataFrame]:
    """Fit TF-IDF and a balanced logistic regression on ``label``; 80/20 stratified.

    The vocabulary is taken from all rows, before the split. Returns the model, its one-row test
    metrics and the vocabulary.
    """
    rows = stage(labelled.select(row_id, "label", text), "text-rows")
    vocabulary = stage(tfidf_vocabulary(rows, text, min_df, max_terms), "vocabulary")
    size = max(vocabulary.count(), 1)
    split = stratified_split(rows, "label", row_id, seed=seed)
    vectors = stage(
        tfidf_vectors(split, row_id, text, vocabulary, size).select("label", "split", "features"),
        "text-vectors",
    )
    train = with_balanced_weight(vectors.filter("split = 'train'"), "label")
    n_train = vectors.filter("split = 'train'").count()
    fitted = LogisticRegression(
        weightCol="weight",
        standardization=False,
        regParam=1.0 / (c * n_train),
        maxIter=max_iter,
        tol=1e-6,
    ).fit(train)
    model = stage_model(rows.sparkSession, fitted, "text-model")
    scored = stage(
        model.transform(vectors.filter("split = 'test'")).select(
            F.col("label").cast("int").alias("label"),
            vector_to_array("probability")[1].alias("score"),
        ),
        "text-scores",
    )
    return model, evaluate(scored, "tfidf-logistic"), vocabulary


def low_score_texts(reviews: DataFrame, *keep: str, low_score_max: int = LOW_SCORE_MAX) -> DataFrame:
    """Texts labelled 1 when the review's score is low."""
    return reviews.select(*keep, _low(low_score_max).alias("label"), "text")


def term_polarity(
    model: LogisticRegressionModel, vocabulary: DataFrame, n: int = 12
) -> DataFrame:
    """The ``n`` terms that speak most for and most against the positive class.

    There is one coefficient per vocabulary term, at most 20,000.
    """
    spark = vocabulary.sparkSession
    pairs = [(i, float(v)) for i, v in enumerate(model.coefficients.toArray())]
    weights = spark.createDataFrame(pairs, "term_index int, coefficient double")
    named = vocabulary.select("term", "term_index").join(weights, "term_index")
    negative = named.orderBy(F.desc("coefficient"), "term").limit(n)
    positive = named.orderBy("coefficient", "term").limit(n)
    return (
        negative.select(F.lit("negative").alias("polarity"), "term", "coefficient")
        .unionByName(positive.select(F.lit("positive").alias("polarity"), "term", "coefficient"))
    )
