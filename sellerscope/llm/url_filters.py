"""URL verdicts: list rules first, then the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes. Outcomes are counted by host, registered domain (the
last two labels) and suffix (the last). Each level's rate of bad pages is beta-binomial around the rate of
the level above: the suffix is shrunk to the overall rate, the domain to its suffix, the host to its
domain. How strongly is estimated from the counts, by the method of moments on how much children scatter
within their parents. A host is blocked if the lower bound of its posterior rate (mean less ``Z`` standard
deviations) is above ``MAX_BAD_RATE``: a few bad pages do not block a host that its domain speaks for.

Pages meet a table of one row a host; only page ids and urls are read. Outcomes are counted before they
move, so a frequent host costs a row for each partition, and adaptive execution splits its pages in the
join.

Defined results: a url that is null or has no "://" has an empty host and path, which are judged like a host
of that name; hosts without outcomes get their domain's, suffix's or the overall rate; repeated pages are
judged and counted each; outcomes without a page or value are not counted. Without any outcome nothing is
blocked by reputation. An empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.645
MAX_BAD_RATE = 0.3
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
# The list rules, each (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ["host", "domain", "suffix"]

Staged = Callable[[DataFrame, str], DataFrame]


def host(url: Column) -> Column:
    """From the first "://" to the next /, ? or #, with A-Z lower-cased; empty if there is none."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """From the host to the next ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule(host: Column, path: Column, rules: list[tuple[str, str]], part: int) -> Column:
    """Verdict (``part`` 0) or text (1) of the longest rule that fits, null if none does.

    A rule fits its host and all hosts below it if the path starts with the rule's. ``rules`` is a parameter of
    a few hundred entries at most. Of equal rules the first counts.
    """
    found = F.lit(None).cast("string")
    for entry in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = entry[1].partition("/")
        below = (host == name) | host.endswith("." + name)
        found = F.when(below & path.startswith(slash + rest), F.lit(entry[part])).otherwise(found)
    return found


def levels(host: Column) -> list[Column]:
    """Host, registered domain and suffix."""
    return [
        host.alias("host"),
        F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0).alias("domain"),
        F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"),
    ]


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def strength(children: DataFrame, parent: str) -> float:
    """Prior weight, in pages, of a parent's rate for its children, from the scatter of (parent, n, bad)."""
    n = F.col("n").cast("double")
    squares = children.groupBy(parent).agg(
        F.count("*").alias("children"),
        F.sum(n).alias("total"),
        F.sum("bad").alias("bads"),
        F.sum(F.col("bad") * F.col("bad") / n).alias("bad_squares"),
        F.sum(n * n).alias("n_squares"),
    )
    rate, free = F.col("bads") / F.col("total"), F.col("children") - 1
    noise = rate * (1 - rate)
    scatter = F.col("bad_squares") - F.col("total") * rate * rate - free * noise
    possible = noise * (F.col("total") - F.col("n_squares") / F.col("total") - free)
    sums = squares.agg(F.sum(scatter).alias("scatter"), F.sum(possible).alias("possible")).first()
    if not sums["possible"] or not sums["scatter"] or sums["scatter"] <= 0:
        return MAX_STRENGTH
    return min(max(sums["possible"] / sums["scatter"] - 1, MIN_STRENGTH), MAX_STRENGTH)


def _below(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """``child`` with the mean of its parent; one row for each child."""
    return child.join(parent.select(key, F.col("mean").alias("prior")), key)


def host_reputation(hosts: DataFrame, outcomes: DataFrame, staged: Staged) -> DataFrame:
    """(host, mean, bound) for every row of ``hosts`` (distinct host); ``outcomes`` has (host, bad 0 or 1)."""
    counted = outcomes.filter("bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    named = hosts.select(*levels(F.col("host")))
    by_host = staged(named.join(counted, "host", "left").select(*LEVELS, zero("n"), zero("bad")), "host-counts")
    by_domain = _counts(by_host, ["domain", "suffix"])
    by_suffix = _counts(by_domain, ["suffix"])
    seen = by_host.filter("n > 0")
    weights = [
        strength(_counts(seen, ["suffix"]).withColumn("all", F.lit(0)), "all"),
        strength(_counts(seen, ["domain", "suffix"]), "suffix"),
        strength(seen, "domain"),
    ]
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = total["bad"] / total["n"] if total["n"] else 0.0
    shrunk = lambda w: ((F.col("bad") + w * F.col("prior")) / (F.col("n") + w)).alias("mean")
    suffix = by_suffix.withColumn("prior", F.lit(overall)).select("suffix", shrunk(weights[0]))
    domain = _below(by_domain, suffix, "suffix").select("domain", shrunk(weights[1]))
    mean = F.col("mean")
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + weights[2] + 1))
    posterior = _below(by_host, domain, "domain").select("host", "n", shrunk(weights[2]))
    return posterior.select("host", "mean", (mean - Z * spread).alias("bound"))


def judge_pages(
    pages: DataFrame,
    outcomes: DataFrame,
    staged: Staged,
    rules: list[tuple[str, str]] | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) of every page; ``outcomes`` has (host, bad 0 or 1)."""
    rules = RULES if rules is None else rules
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    known = staged(host_reputation(rows.select("host").distinct(), outcomes, staged), "host-reputation")
    method = F.when(F.col("bound") > MAX_BAD_RATE, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        rule(F.col("host"), F.col("path"), rules, 1).alias("rule"),
        F.coalesce(rule(F.col("host"), F.col("path"), rules, 0), method).alias("verdict"),
        "mean",
        "bound",
    )
