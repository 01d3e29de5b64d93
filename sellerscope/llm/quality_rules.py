"""Quality rules whose cutoffs are chosen on labelled documents under a limit on false rejections.

Fixed rules come first: too few words, or too many of them in repeated passages. Then each rule of
``RULES`` rejects a document whose rate exceeds the cutoff of the document's stratum. Cutoffs are tested on
a holdout of documents labelled good: with n of them in a stratum, of which a cutoff would reject k, the
cutoff is safe if a binomial variable with the rule's allowed share of false rejections is at most k with small
probability (the exact one-sided binomial bound). The shares of the rules add up to the share allowed to all of them.
The error probability ``DELTA`` is divided by strata x rules. It is not divided by the cutoffs: those of a rule are
nested and tested in a fixed order, from lax to strict, until one fails, so an unsafe cutoff is used only if the laxest
unsafe one passes its test. With probability 1 - DELTA no stratum loses more than 2 in 100 of its good
documents to all rules together. The strictest cutoff that was passed is used; where there is none, as in strata with few
labels (with five strata, below about 750 for the widest share and 2,000 for the narrowest), the rule is not applied.

Everything is DataFrame expressions. Texts are read once; the labelled rows that are shuffled carry ids and
rates only, and are counted by cutoff before they move.

Defined results: a null text has no words and fails the fixed rules; strata with null form a stratum of
their own; rows without an id, or with one that has no label, are judged and not counted; of several
labels of an id the lowest counts; repeated rows are judged one by one. An empty table, or empty
labels, gives no rows, or cutoffs that are never applied. Other columns, whatever they are called, are
carried by ``filter_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerscope.functions.expressions import bind

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
DELTA = 0.05
CUTOFFS = [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5]
# Share of a stratum's good documents that each rule may reject, stated beforehand: 2 in 100 altogether. Repeated passages
# and lines get most of it, as they are the commonest fault of crawled text.
RULES = {"symbol_rate": 0.003, "shout_rate": 0.003, "dup_line_rate": 0.006, "repeat_rate": 0.008}

# White space between words, counted symbols.
WHITE = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.coalesce(F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def _repeated_starts(tokens: Column, hashes: Column) -> Column:
    """Ascending 0-based starts of the windows that occur more than once, compared as texts."""
    keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_: Column, key: str) -> Column:
        def same(x: Column, i: Column) -> Column:
            before = F.get(sorted_, i - 1)[key] == x[key]
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)[key] == x[key], F.lit(False))

        return F.filter(sorted_, same)

    text = lambda i: F.array_join(F.slice(tokens, i + 1, WINDOW), " ")
    maybe = bind(keyed, lambda s: again(s, "h"))
    exact = bind(
        F.array_sort(F.transform(maybe, lambda x: F.struct(text(x["i"]).alias("t"), x["i"].alias("i")))),
        lambda s: again(s, "t"),
    )
    return F.array_sort(F.transform(exact, lambda x: x["i"]))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that occurs more than once in the text."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))

    def covered(p: Column) -> Column:
        # a window adds the words up to the next one
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def of(hashes: Column) -> Column:
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, bind(_repeated_starts(tokens, hashes), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(n >= WINDOW, bind(windows, of)).otherwise(F.lit(0).cast("long"))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts that rules use; all 0 for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{WHITE}]"))

    def line_counts(found: Column) -> Column:
        distinct = F.size(F.array_distinct(found))
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - distinct).cast("long").alias("dup"))

    def of(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            repeated_words(tokens).alias("n_repeat_words"),
        )

    return F.struct(
        bind(words(text), of).alias("words"),
        bind(lines, line_counts).alias("lines"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "!").alias("n_shouts"),
    )


def measured(docs: DataFrame, stratum: Column, text: Column) -> DataFrame:
    """The rows of ``docs`` as struct ``doc``, with their stratum, counts, rates and the fixed verdict."""
    m = docs.select(F.struct("*").alias("doc"), stratum.alias("stratum"), measures(text).alias("m"))
    flat = m.select(
        "doc",
        "stratum",
        F.col("m.words.n_words").alias("n_words"),
        F.col("m.words.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.words.n_repeat_words").alias("n_repeat_words"),
        F.col("m.lines.n").alias("n_lines"),
        F.col("m.n_shouts").alias("n_shouts"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    too_few = F.col("n_words") < MIN_WORDS
    too_repeated = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return flat.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_rate"),
        share("n_shouts", "word_chars").alias("shout_rate"),
        share("n_dup_lines", "n_lines").alias("dup_line_rate"),
        share("n_repeat_words", "n_words").alias("repeat_rate"),
        (too_few | too_repeated).alias("base_failed"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x!: exact up to 20, beyond it Stirling's series, whose error is below 1e-12."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 where k is not below the mean, which no test accepts anyway.

    Summed from the largest term down; terms more than 12 standard deviations away are below rounding.
    """
    p = F.lit(p)
    log_first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    steps = F.least(k, F.ceil(60 + 12 * F.sqrt(n.cast("double"))))
    start = F.struct(F.exp(log_first).alias("term"), F.exp(log_first).alias("sum"))

    def down(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.aggregate(terms, start, down, lambda a: a["sum"])).otherwise(F.lit(1.0))


def rule_counts(scored: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """(stratum, rule, cutoff, n, k): labelled good documents and how many of them a cutoff rejects.

    Counted by how many cutoffs a rate exceeds, so what is shuffled per partition is a row for each
    stratum, rule and number.
    """
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    held = scored.select(F.col(f"doc.{id_column}").alias("doc_id"), "stratum", *RULES).join(good, "doc_id", "left_semi")
    exceeded = lambda c: sum(((F.col(c) > x).cast("int") for x in CUTOFFS), F.lit(0))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), exceeded(r).alias("passed")) for r in RULES])
    counts = held.select("stratum", F.explode(listed).alias("x")).groupBy("stratum", "x.rule", "x.passed").agg(F.count("*").alias("rows"))
    per_rule = counts.groupBy("stratum", "rule").agg(
        F.sum("rows").alias("n"),
        *[F.sum(F.when(F.col("passed") > i, F.col("rows")).otherwise(0)).alias(f"k{i}") for i in range(len(CUTOFFS))],
    )
    tests = F.array(*[F.struct(F.lit(x).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, x in enumerate(CUTOFFS)])
    return per_rule.select("stratum", "rule", "n", F.explode(tests).alias("t")).select("stratum", "rule", "n", "t.cutoff", "t.k")


def safe_cutoffs(counts: DataFrame) -> DataFrame:
    """A row a stratum with the strictest cutoff of every rule that is passed from lax to strict; null where none is."""
    strata = counts.agg(F.greatest(F.count_distinct(F.struct("stratum")), F.lit(1))).scalar()
    share = F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), F.col("rule"))
    p_value = binomial_tail(F.col("k"), F.col("n"), share)
    tested = counts.select("stratum", "rule", "cutoff", (p_value * strata * len(RULES) <= DELTA).alias("safe"))
    # Tests end at the laxest cutoff that fails.
    ended = tested.groupBy("stratum", "rule").agg(
        F.max(F.when(~F.col("safe"), F.col("cutoff"))).alias("failed"), F.collect_set("cutoff").alias("cutoffs")
    )  # at most one element for each of CUTOFFS
    passed = F.array_min(F.filter("cutoffs", lambda x: F.col("failed").isNull() | (x > F.col("failed"))))
    chosen = ended.select("stratum", "rule", passed.alias("cutoff"))
    return chosen.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])


def judged(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``scored`` with ``kept``: not failed by the fixed rules nor over a cutoff of the stratum."""
    limits = cutoffs.withColumnRenamed("stratum", "of_stratum")
    joined = scored.join(limits, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    over = F.lit(False)
    for r in RULES:
        over |= F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("of_stratum", *[f"max_{r}" for r in RULES])


def _cutoffs(scored: DataFrame, labels: DataFrame, id_column: str, staged: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    counts = staged(rule_counts(scored, labels, id_column), "rule-counts")
    return staged(safe_cutoffs(counts), "rule-cutoffs")


def judge_documents(
    docs: DataFrame,
    labels: DataFrame,
    staged: Callable[[DataFrame, str], DataFrame],
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "lang",
) -> DataFrame:
    """(doc_id, counts, rates, base_failed, kept) of every row; ``labels`` has (doc_id, quality 0 or 1)."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(stratum_column).alias("lang"))
    found = measured(slim, F.col("lang"), F.col("text")).withColumn("doc", F.struct("doc.doc_id"))
    scored = staged(found, "rule-measures")
    return judged(scored, _cutoffs(scored, labels, "doc_id", staged)).select("doc.doc_id", "*").drop("doc")


def filter_documents(
    docs: DataFrame,
    labels: DataFrame,
    staged: Callable[[DataFrame, str], DataFrame],
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are stored once with their rates."""
    scored = staged(measured(docs, F.col(stratum_column), F.col(text_column)), "rule-measures")
    cutoffs = _cutoffs(scored, labels, id_column, staged)
    return judged(scored, cutoffs).filter("kept").select("doc.*")
