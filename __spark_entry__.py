"""Entry points: the flagship query, every registered query and the SQL each is checked against."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from sellerscope.functions.expressions import clip, round_sql  # noqa: E402
from sellerscope.operators import attribution, features, metrics, models, splits, text, tree_attribution  # noqa: E402
from sellerscope.operators import seller_score as seller  # noqa: E402
from sellerscope.plans import reports, views  # noqa: E402
from sellerscope.session import ROW_KEYS, side_by_side, stage, staging_path  # noqa: E402
from sellerscope.settings import (  # noqa: E402
    FEATURE_COLUMNS,
    NEGATIVE_LABEL_MAX_SCORE,
    SCORE_GRADES,
    SCORE_WEIGHTS,
)
from sellerscope.sources.csv_tables import QUOTED_BREAKS, load_catalog, open_catalog, read_csv_table, register_views  # noqa: E402
from sellerscope.sources.artifacts import (  # noqa: E402
    load_model,
    read_csv_or_empty,
    read_or_build,
    save_model,
    write_csv,
    write_parquet,
)
from sellerscope.sources.testdata import from_testdata, read_table, read_texts  # noqa: E402
from sellerscope.tables import Tables  # noqa: E402

try:
    from sellerscope.llm import queries as llm_queries
except ImportError as error:  # the subpackage is optional, the libraries it uses are not
    if error.name not in ("sellerscope.llm", "corpus_pipeline"):
        raise
    llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

# Folders of the compared models and of their rows, by application, tables and name: made by the first query that
# asks for them.
_TRAINED: dict[tuple[str, str, str], str] = {}

# A fixed linear model over all features, to check attribution without training.
LINEAR_WEIGHTS = {
    name: round((1.0 if i % 2 else -1.0) / (i + 2), 4) for i, name in enumerate(FEATURE_COLUMNS)
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the graded 0-100 seller score."""
    return seller.seller_trust_scores(from_testdata(spark, "/root/testdata/sf0.001"))


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(from_testdata(spark, sf_dir))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles that come out of sums, whose last digits depend on the order of addition."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: round_sql(F.col(c), digits) for c in names})


_HISTORY = "seller_avg_review_hist"


def _scores(t: Tables) -> DataFrame:
    return seller.seller_trust_scores(t)


def _features(t: Tables) -> DataFrame:
    return stage(features.order_features(t), "order-features")


def _labels(t: Tables) -> DataFrame:
    """Key, time and label of every (delivered order, scored review)."""
    delivered = t.orders.filter("order_status = 'delivered'").select(
        "order_id", "order_purchase_timestamp"
    )
    label = (F.col("review_score") <= NEGATIVE_LABEL_MAX_SCORE).cast("int")
    reviews = t.order_reviews.filter("review_score IS NOT NULL").select("order_id", "review_score")
    return delivered.join(reviews, "order_id").withColumn("is_negative", label)


def _margin_risk(t: Tables) -> DataFrame:
    """A fixed linear risk score on the delivery margin, with many ties."""
    score = F.floor((F.lit(0.5) - views.days_vs_estimate() / F.lit(80.0)) * 1000) / F.lit(1000.0)
    orders = t.orders.filter("order_delivered_customer_date IS NOT NULL").select(
        "order_id", clip(score.cast("double"), 0.0, 1.0).alias("score")
    )
    label = (F.col("review_score") <= NEGATIVE_LABEL_MAX_SCORE).cast("int")
    return orders.join(t.order_reviews, "order_id").select(
        "review_id", label.alias("label"), "score"
    )


def _predicted(t: Tables) -> DataFrame:
    return metrics.with_prediction(_margin_risk(t))


def _texts(t: Tables) -> DataFrame:
    return text.reviews_with_text(t, "review_id")


def _sample(t: Tables) -> DataFrame:
    return text.labelled_sample(_texts(t), "review_id")


def _orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(from_testdata(spark, sf_dir))
    return reports.run_sql(
        spark, "SELECT order_status, COUNT(*) AS n FROM orders GROUP BY order_status;"
    )


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stage(from_testdata(spark, sf_dir).orders, "orders")
    path = staging_path(spark, "orders-csv")
    write_csv(source, path)
    return read_csv_table(spark, "orders", path)


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str], Tables, DataFrame]:
    """Folder of a catalog loaded from CSV copies of the tables, its source files, the tables and the load's report."""
    root = staging_path(spark, "catalog")
    tables = from_testdata(spark, sf_dir)
    # The generated data has no places; the nation table stands in, as it is loaded but not read.
    sources = dict(tables.items()) | {"geolocation": read_table(spark, sf_dir, "nation")}
    # The copies take several times the space of the tables; those read by their bytes stay plain.
    codecs = {name: "none" if name in QUOTED_BREAKS else "gzip" for name in sources}
    side_by_side({name: partial(write_csv, frame, f"{root}/csv/{name}", codecs[name]) for name, frame in sources.items()})
    files = {name: name for name in sources}
    return root, files, *load_catalog(spark, f"{root}/csv", f"{root}/tables", files)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[3]


def _catalog_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix from bucketed tables, which meet on the order without a shuffle."""
    return _rounded(features.order_features(_loaded(spark, sf_dir)[2]), 9, _HISTORY)


def _catalog_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of every table as a reader finds them after a later load broke off."""
    root, files, _, _ = _loaded(spark, sf_dir)
    try:
        load_catalog(spark, f"{root}/csv", f"{root}/tables", {**files, "orders": "sellers", "sellers": "absent"})
    except FileNotFoundError:
        pass
    sizes = [
        frame.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(frame.columns)).alias("n_cols"))
        for name, frame in open_catalog(spark, f"{root}/tables").items()
    ]
    return reduce(DataFrame.unionByName, sizes)


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        features.to_timestamp_or_missing(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        ).alias("ordered"),
        features.to_timestamp_or_missing(F.col("o_orderstatus")).alias("bad_date"),
    )
    return features.numeric_or_missing(orders, ["price", "priority", "absent"])


def _scenarios(frame: DataFrame) -> DataFrame:
    """One scenario per customer state: the largest value of each input among its orders."""
    extremes = [F.max(c).alias(c) for c in models.SCENARIO_COLUMNS]
    return frame.groupBy("customer_state").agg(*extremes)


def _what_if_rows(frame: DataFrame) -> DataFrame:
    typical = features.medians(frame, FEATURE_COLUMNS)
    return models.scenario_rows(_scenarios(frame), typical)


def _parts_of(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the train and test rows of the compared models."""
    key = (spark.sparkContext.applicationId, sf_dir, "parts")
    if key not in _TRAINED:
        path = staging_path(spark, "model-rows")
        parts = models.timed_parts(features.order_features(from_testdata(spark, sf_dir)))
        for name in ("train", "test"):
            parts[name].drop(*ROW_KEYS).write.parquet(f"{path}/{name}")
        _TRAINED[key] = path
    return _TRAINED[key]


def _part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{_parts_of(spark, sf_dir)}/{name}")


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """Folders of the named models; those not trained yet are, side by side."""
    train, test = (_part(spark, sf_dir, name) for name in ("train", "test"))
    keys = {name: (spark.sparkContext.applicationId, sf_dir, name) for name in names}

    def train_one(name: str) -> str:
        path = staging_path(spark, name)
        model, row = models.fit_and_evaluate(name, models.trainers()[name], train, test)
        save_model(model, path, name, FEATURE_COLUMNS, row)
        _TRAINED[keys[name]] = path
        return path

    side_by_side({name: partial(train_one, name) for name in names if keys[name] not in _TRAINED})
    return {name: _TRAINED[keys[name]] for name in names}


def _model(spark: SparkSession, sf_dir: str, name: str):
    return load_model(spark, _stored(spark, sf_dir, name)[name])[0]


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _stored(spark, sf_dir, *models.trainers())
    return reduce(DataFrame.unionByName, (load_model(spark, path)[3] for path in folders.values()))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.model_ranking(_metrics(spark, sf_dir))


def _winner(spark: SparkSession, sf_dir: str):
    """The best of the compared models."""
    return _model(spark, sf_dir, metrics.best_model(_metrics(spark, sf_dir)).first()["model"])


def _winner_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(models.predictions(_winner(spark, sf_dir), _part(spark, sf_dir, "test"), "order_id"), "predictions")


def _what_if_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _what_if_rows(_part(spark, sf_dir, "train"))
    return metrics.risk_tiers(models.score(_winner(spark, sf_dir), rows, "customer_state"))


def _boosted_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir, "boosted_shallow")
    attributed = tree_attribution.tree_attribution(_part(spark, sf_dir, "train"), model)
    return tree_attribution.mean_absolute_contributions(attributed)


def _attribution_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_attribution.additivity_violations(_part(spark, sf_dir, "test"), _model(spark, sf_dir, "boosted_shallow"))


def _logistic_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir, "logistic")
    scaled = model.stages[0].transform(_part(spark, sf_dir, "train"))
    return attribution.linear_attribution(scaled, attribution.logistic_coefficients(model))


def _model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predictions(_model(spark, sf_dir, "logistic"), _part(spark, sf_dir, "test"), "order_id")


def _violations(frame: DataFrame, *wrong: str) -> DataFrame:
    """How many rows are wrong in one of the ways named."""
    return frame.agg(F.count_if(F.expr(" OR ".join(f"coalesce({w}, true)" for w in wrong))).alias("n_violations"))


def _prediction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose score is no probability or whose class does not follow from it."""
    return _violations(_model_predictions(spark, sf_dir), "score NOT BETWEEN 0 AND 1", "(score >= 0.5) <> (prediction = 1)")


def _restored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows that a model scores otherwise once it has been saved and loaded again."""
    model, test = _model(spark, sf_dir, "logistic"), _part(spark, sf_dir, "test")
    path = staging_path(spark, "saved-again")
    save_model(model, path, "logistic", FEATURE_COLUMNS, load_model(spark, _stored(spark, sf_dir, "logistic")["logistic"])[3])
    scored = model.transform(test).withColumnRenamed("probability", "before").drop("scaled", "features", "rawPrediction", "prediction")
    again = load_model(spark, path)[0].transform(scored.drop(*[c for c in scored.columns if c.startswith("scaled_")]))
    return _violations(again.select(F.col("before").cast("string").alias("a"), F.col("probability").cast("string").alias("b")), "a <> b")


def _ranking_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the comparison out of place, missing, or with a figure that is no share."""
    listed = F.collect_list(F.struct("model", "roc_auc", "pr_auc", "f1", "accuracy")).alias("m")
    table = _ranking(spark, sf_dir).groupBy().agg(listed)  # a row for each model
    shares = "exists(m, x -> x.roc_auc NOT BETWEEN 0.5 AND 1 OR x.pr_auc NOT BETWEEN 0 AND 1 OR x.f1 NOT BETWEEN 0 AND 1 OR x.accuracy NOT BETWEEN 0 AND 1)"
    sorted_ = "array_sort(m, (x, y) -> CASE WHEN x.roc_auc > y.roc_auc THEN -1 WHEN x.roc_auc < y.roc_auc THEN 1 WHEN x.model < y.model THEN -1 ELSE 1 END) <> m"
    return _violations(table, shares, sorted_, f"size(m) <> {len(models.trainers())}")


def _what_if_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios whose risk is no probability."""
    return _violations(_what_if_risk(spark, sf_dir), "score NOT BETWEEN 0 AND 1")


def _stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix through its parquet sink; the second time it is read, not built."""
    path = f"{staging_path(spark, 'stored')}/order_features.parquet"
    build = lambda: features.order_features(from_testdata(spark, sf_dir))
    write_parquet(read_or_build(spark, path, build), path)
    return _rounded(read_or_build(spark, path, lambda: spark.range(0)), 9, _HISTORY)


def _stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report through its CSV sink and scan."""
    report = reports.run_report(from_testdata(spark, sf_dir), "state_performance")
    path = f"{staging_path(spark, 'stored')}/state_performance.csv"
    write_csv(report, path)
    return read_csv_or_empty(spark, path, report.schema)


def _report_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every report, and how many of them a preview shows."""
    found = [(name, n, top.count()) for name, n, top in reports.preview_reports(from_testdata(spark, sf_dir))]
    return spark.createDataFrame(found, "report string, n_rows bigint, n_shown bigint")


def _test_labels(t: Tables) -> DataFrame:
    """What of the predictions does not depend on training: keys and labels of the test rows."""
    test = models.timed_parts(features.order_features(t))["test"]
    return test.select("order_id", F.col("is_negative").alias("label"))


def _document_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS label")
    documents = read_texts(spark, sf_dir, "documents", "doc_id", "text")
    return text.train_text_classifier(documents.join(labels, "doc_id"), "doc_id")[1]


def _text_classifier(t: Tables) -> DataFrame:
    labelled = text.low_score_texts(_texts(t), "review_id")
    return text.train_text_classifier(labelled, "review_id")[1]


def _top_terms(t: Tables) -> DataFrame:
    labelled = text.low_score_texts(_texts(t), "review_id")
    model, _, vocabulary = text.train_text_classifier(labelled, "review_id")
    return text.term_polarity(model, vocabulary)


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text.tfidf(read_texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"), 9)


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text.with_words(read_texts(spark, sf_dir, "documents", "doc_id", "text"))
    return documents.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def _document_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_texts(spark, sf_dir, "documents", "doc_id", "text")
    return _rounded(text.lexicon_labels(documents).drop("text"), 9)


def queries() -> dict[str, Query]:
    on = _on_tables
    grade = SCORE_GRADES[0][1]
    table_queries = {
        # views
        "order_core": views.order_core,
        "seller_orders": lambda t: views.seller_orders(t).withColumns(
            {c: F.col(c).cast("double") for c in ("price", "freight_value")}
        ),
        # reports
        **reports.REPORTS,
        "review_score_distribution_labels": reports.review_score_labels,
        "overview_kpis": lambda t: _rounded(reports.overview_kpis(t), 9, "avg_score"),
        # seller score
        "seller_stats": seller.seller_stats,
        "trust_components": lambda t: _rounded(
            seller.score_components(seller.seller_stats(t)), 9
        ).select("seller_id", *[f"u_{c}" for c in SCORE_WEIGHTS]),
        "seller_trust_scores": _scores,
        "trust_breakdown": lambda t: seller.trust_breakdown(_scores(t)),
        "grade_counts": lambda t: seller.grade_counts(_scores(t)),
        "trust_summary": lambda t: _rounded(seller.trust_summary(_scores(t)), 9),
        "trust_histogram": lambda t: _rounded(seller.trust_histogram(_scores(t)), 6),
        "trust_top_bottom": lambda t: seller.trust_top_bottom(_scores(t)),
        "trust_by_grade": lambda t: seller.sellers_of_grade(_scores(t), grade),
        "grades_present": lambda t: seller.grades_present(_scores(t)),
        # features
        "seller_history": lambda t: _rounded(features.seller_history(t), 9),
        "order_features_raw": lambda t: _rounded(features.unfilled_features(t), 9, _HISTORY),
        "order_features": lambda t: _rounded(features.order_features(t), 9, _HISTORY),
        "feature_medians": lambda t: _rounded(
            features.feature_medians(features.unfilled_features(t)), 9
        ),
        "target_profile": lambda t: _rounded(
            features.target_profile(features.order_features(t)), 6, "target_rate"
        ),
        "state_codes": lambda t: features.state_codes(features.unfilled_features(t)),
        "standardized_features": lambda t: (
            lambda f: _rounded(features.standardize(f, f), 6)
        )(_features(t)),
        "class_weights": lambda t: _rounded(splits.class_weights(features.order_features(t)), 9),
        "linear_attribution": lambda t: _rounded(
            attribution.linear_attribution(_features(t), LINEAR_WEIGHTS), 4
        ),
        "what_if_rows": lambda t: _rounded(_what_if_rows(_features(t)), 9, _HISTORY),
        # splits and samples
        "time_split": lambda t: splits.time_split(stage(_labels(t), "labels")).select(
            "order_id", "review_score", "split"
        ),
        "time_split_validation": lambda t: splits.time_split(
            stage(_labels(t), "labels"), validation_fraction=0.1
        ).select("order_id", "review_score", "split"),
        "stratified_split": lambda t: splits.stratified_split(
            stage(text.low_score_texts(_texts(t), "review_id"), "texts"), "label", "review_id"
        ).drop("text"),
        "seeded_sample": lambda t: splits.seeded_sample(
            t.orders.select("order_id", "order_status"), "order_id", 2000
        ),
        "oversample": lambda t: splits.oversample(
            stage(_labels(t).drop("order_purchase_timestamp"), "labels"),
            ["order_id", "review_score"],
        )
        .groupBy("order_id", "review_score", "is_negative")
        .agg(F.count("*").alias("n_copies")),
        # metrics
        "risk_tiers": lambda t: metrics.risk_tiers(_margin_risk(t)),
        "roc_auc": lambda t: _rounded(metrics.roc_auc(_margin_risk(t)), 9),
        "average_precision": lambda t: _rounded(metrics.average_precision(_margin_risk(t)), 9),
        "binary_metrics": lambda t: _rounded(metrics.binary_metrics(_predicted(t)), 9),
        "confusion_matrix": lambda t: metrics.confusion_matrix(_predicted(t)),
        "classification_report": lambda t: _rounded(
            metrics.classification_report(_predicted(t)), 9
        ),
        # text
        "reviews_with_text": _texts,
        "lexicon_scores": lambda t: _rounded(text.lexicon_scores(_texts(t)).drop("text"), 9),
        "lexicon_labels": lambda t: text.lexicon_labels(_texts(t)).drop("text", "lexicon_score"),
        "lexicon_eval": lambda t: text.lexicon_eval(_texts(t)),
        "labelled_sample": lambda t: _sample(t).drop("lexicon_score"),
        "sentiment_mix": lambda t: text.sentiment_mix(text.lexicon_labels(_texts(t))),
        "text_reviews_by_score": lambda t: text.text_reviews_by_score(_texts(t)),
        # models: trained, so without SQL to compare to
        "model_test_labels": _test_labels,
        "mlp_metrics": lambda t: models.train_mlp(features.order_features(t)).metrics,
        "text_classifier": _text_classifier,
        "top_terms": _top_terms,
    }
    return {
        **{name: on(build) for name, build in table_queries.items()},
        "model_ranking": _ranking,
        "model_predictions": _model_predictions,
        "best_model_report": lambda spark, sf_dir: metrics.classification_report(_winner_predictions(spark, sf_dir)),
        "best_model_confusion": lambda spark, sf_dir: metrics.confusion_matrix(_winner_predictions(spark, sf_dir)),
        "what_if_risk": _what_if_risk,
        "boosted_attribution": _boosted_attribution,
        "logistic_attribution": _logistic_attribution,
        "attribution_additivity": _attribution_additivity,
        "prediction_rules": _prediction_rules,
        "restored_scores": _restored_scores,
        "ranking_rules": _ranking_rules,
        "what_if_rules": _what_if_rules,
        "stored_features": _stored_features,
        "stored_report": _stored_report,
        "report_previews": _report_previews,
        "orders_by_status": _orders_by_status,
        "csv_scan": _csv_scan,
        "catalog_load": _catalog,
        "catalog_features": _catalog_features,
        "catalog_after_failure": _catalog_after_failure,
        "coerced_orders": _coerced,
        "tokens": _tokens,
        "document_lexicon": _document_lexicon,
        "tfidf_vocab": lambda spark, sf_dir: text.tfidf_vocabulary(
            read_texts(spark, sf_dir, "documents", "text")
        ),
        "tfidf": _tfidf,
        "document_classifier": _document_classifier,
        **(llm_queries.queries() if llm_queries else {}),
    }


def oracle_sql() -> dict[str, str]:
    llm_sql = llm_queries.oracle_sql() if llm_queries else {}
    return {**oracle_queries.statements(LINEAR_WEIGHTS), **llm_sql}
