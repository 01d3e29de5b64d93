"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sellerscope.llm import (
    alignment,
    decontamination,
    html_text,
    near_duplicates,
    oracles,
    packing,
    quality_rules,
    repeated_text,
    repeated_windows,
    secret_scan,
    token_counts,
    token_files,
    url_filters,
    whitening,
)
from sellerscope.session import stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose document, named by the number in the path, is labelled."""
    url = F.col("url")
    number = F.regexp_extract(url_filters.path(url), "/([0-9]{1,18})[^/]*/?$", 1)
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    named = pages.select(url_filters.host(url).alias("host"), F.when(number != "", number).cast("bigint").alias("doc_id"))
    return named.join(known, "doc_id").select("host", "bad")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = stage(page_outcomes(pages, _table(spark, sf_dir, "labels")), "page-outcomes")
    return url_filters.judge_pages(pages, outcomes, stage).select("page_id", "host", "path", "rule", "verdict")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), stage)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text.remove_repeats(_table(spark, sf_dir, "documents"), stage).drop("spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), stage)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"), stage)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.token_file_index(token_files.read_token_files(spark, path), stage)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), stage)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stage(pieces, "token-pieces"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), stage)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align(_table(spark, sf_dir, "documents"), *vocabularies, stage)
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows.remove_repeated_windows(_table(spark, sf_dir, "documents"), stage)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    own = [
        op1_token_counts,
        op2_url_filters,
        op3_html_text,
        op4_decontamination,
        op5_repeated_text,
        op6_quality_rules,
        op7_secret_scan,
        op8_token_files,
        op9_near_duplicates,
        op10_best_fit_packing,
        op11_embedding_whitening,
        op12_tokenizer_alignment,
        op13_substring_dedup,
    ]
    return {q.__name__: q for q in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.statements() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
