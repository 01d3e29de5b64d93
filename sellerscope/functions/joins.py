"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE_FACTOR = 4  # bytes in memory for each estimated byte
MAX_HOT = 1024  # a key with a greater share than 1 / MAX_HOT of the rows is spread
TRACKED = 1 << 16  # keys that a frequent-items sketch follows
_UNITS = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate of ``df`` is within the broadcast threshold.

    The estimate starts from compressed file sizes, scaled to the columns read, so it can be lower
    than the rows in memory; ``SIZE_FACTOR`` allows for that. Joins multiply it and filters or
    groupings never lower it. Unknown sizes answer False.
    """
    spark = df.sparkSession
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b"))
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return limit > 0 and SIZE_FACTOR * int(str(estimate)) <= limit


def heavy_hitters(facts: DataFrame, key: str, partitions: int) -> Column:
    """Map of very frequent keys to the number of tasks their rows are worth, as a scalar subquery.

    A mergeable frequent-items sketch finds the keys that hold more than 1 / ``MAX_HOT`` of the rows, so there
    are at most that many; it follows ``TRACKED`` keys, which bounds its error to well below that share. The tasks of
    all keys together are at most twice ``partitions`` and one for each key.
    """
    found = facts.agg(F.expr(f"approx_top_k(`{key}`, {MAX_HOT}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    tasks = lambda x: F.ceil(2.0 * partitions * x["count"] / F.col("n")).cast("int")
    hot = F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] * MAX_HOT > F.col("n")))
    return found.select(F.map_from_entries(F.transform(hot, lambda x: F.struct(x["item"], tasks(x))))).scalar()


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str,
    spread_by: str,
) -> DataFrame:
    """Join ``facts`` to a frame with one row per ``key`` where some keys may be very frequent.

    A lookup of proven small size is broadcast, so the facts do not move. Otherwise the rows of a heavy hitter
    are spread, by a hash of ``spread_by``, over as many tasks as they are worth, and only its row of the lookup is repeated
    for them; all other keys take part in a plain shuffle join. Rows with a missing key are spread over all tasks. The
    facts' key column is read once more, to find the heavy hitters.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup_join supports inner and left, not {how}")
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), key, how)
    partitions = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    hot = heavy_hitters(facts, key, partitions)
    tasks = F.coalesce(F.try_element_at(hot, F.col(key)), F.lit(1))
    spread = F.when(F.col(key).isNull(), F.lit(partitions)).otherwise(tasks)
    dealt_facts = facts.withColumn("_task", F.pmod(F.xxhash64(spread_by), spread).cast("int"))
    dealt_lookup = lookup.withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt_facts.join(dealt_lookup, [key, "_task"], how).drop("_task")


def left_join_many(left: DataFrame, right: DataFrame, key: str, skewed_right: bool = False) -> DataFrame:
    """Left join that keeps the fan-out of ``right``, whose keys may be very frequent.

    Adaptive execution can split an oversized partition of either side of an inner join, but only
    the left side of a left join. Where the right side is known to have very frequent keys, matches
    come from an inner join and the rows without a match from an anti join against the distinct
    keys; both sides are then read twice.
    """
    if not skewed_right:
        return left.join(right, key, "left")
    matched = left.join(right, key, "inner")
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
