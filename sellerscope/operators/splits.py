"""Time-ordered and stratified splits, seeded samples and oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerscope.functions.expressions import seeded_mix
from sellerscope.functions.ranks import running_totals, sorts_before
from sellerscope.settings import RANDOM_SEED

_LAST = 2**63 - 1


def id_key(frame: DataFrame, name: str) -> Column:
    """An id as bigint sort key: itself if it is an integer, else its 64-bit hash."""
    if isinstance(frame.schema[name].dataType, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(_LAST))
    return F.xxhash64(name)


def time_key(name: str) -> Column:
    """A timestamp as microseconds, missing ones last."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("MICROSECOND", epoch, F.col(name)), F.lit(_LAST))


def seeded_key(frame: DataFrame, name: str, seed: int) -> Column:
    """Pseudo-random order of ids fixed by the seed."""
    if isinstance(frame.schema[name].dataType, T.IntegralType):
        return F.coalesce(seeded_mix(F.col(name), seed), F.lit(_LAST))
    return F.xxhash64(F.lit(seed), F.col(name))


def time_split(
    frame: DataFrame,
    time: str = "order_purchase_timestamp",
    ties: Sequence[str] = ("order_id", "review_score"),
    test_fraction: float = 0.2,
    validation_fraction: float | None = None,
) -> DataFrame:
    """Add ``split``: the earliest rows are ``train``, the latest ``test``.

    The cut is at ``int(n * (1 - test_fraction))`` rows in time order, ties ordered by ``ties``.
    With a validation fraction the end of the train part becomes ``val`` in the same way. The
    splits are filters on the keys, no row is sorted or moved. ``frame`` is read several times, so
    it should be a stored table.
    """
    keys = [time_key(time), *[id_key(frame, t) for t in ties]]
    cut = int(frame.count() * (1 - test_fraction))
    early = sorts_before(frame, keys, cut)
    label = F.when(early, "train")
    if validation_fraction is not None:
        fitted = sorts_before(frame, keys, int(cut * (1 - validation_fraction)))
        label = F.when(fitted, "train").when(early, "val")
    return frame.withColumn("split", label.otherwise("test"))


def stratified_split(
    frame: DataFrame,
    label: str,
    row_id: str,
    test_fraction: float = 0.2,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Add ``split``: in every class the same share of rows, in seeded order, is ``test``."""
    keys = [seeded_key(frame, row_id, seed), id_key(frame, row_id)]
    classes = frame.groupBy(label).count().collect()  # one row per class
    test = F.lit(False)
    for row in classes:
        members = F.col(label).eqNullSafe(F.lit(row[label]))
        quota = int(row["count"] * test_fraction)
        test = test | (members & sorts_before(frame.filter(members), keys, quota))
    return frame.withColumn("split", F.when(test, "test").otherwise("train"))


def seeded_sample(frame: DataFrame, row_id: str, size: int, seed: int = RANDOM_SEED) -> DataFrame:
    """A fixed number of rows in seeded order.

    The last wanted key is found by counting, so the sample is a filter on the keys; only the chosen rows, and
    rows that repeat the last one, are sorted to cut off such repeats. ``frame`` is read several times.
    """
    keys = [seeded_key(frame, row_id, seed), id_key(frame, row_id)]
    return frame.filter(sorts_before(frame, keys, size)).orderBy(*keys).limit(size)


def class_weights(frame: DataFrame, label: str = "is_negative") -> DataFrame:
    """Per class: rows, balanced weight n / (2 * rows), and negatives per positive."""
    positives = F.sum(F.col(label).cast("bigint"))
    totals = frame.agg(F.count("*").alias("n"), positives.alias("n_pos"))
    rows = F.array(
        F.struct(F.lit(0).alias(label), (F.col("n") - F.col("n_pos")).alias("n_rows")),
        F.struct(F.lit(1).alias(label), F.col("n_pos").alias("n_rows")),
    )
    ratio = (F.col("n") - F.col("n_pos")) / F.greatest(F.col("n_pos"), F.lit(1))
    balanced = F.try_divide(F.col("n").cast("double"), F.lit(2.0) * F.col("row.n_rows"))
    return totals.select("n", ratio.alias("pos_weight"), F.explode(rows).alias("row")).select(
        f"row.{label}", "row.n_rows", balanced.alias("balanced_weight"), "pos_weight"
    )


def with_balanced_weight(frame: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced class weight to every row."""
    figures = class_weights(frame, label).groupBy().agg(
        F.max(F.when(F.col(label) == 0, F.col("balanced_weight"))).alias("w0"),
        F.max(F.when(F.col(label) == 1, F.col("balanced_weight"))).alias("w1"),
    )
    one = figures.select(F.struct("w0", "w1")).scalar()
    return (
        frame.withColumn("_w", one)
        .withColumn(name, F.when(F.col(label) == 1, F.col("_w.w1")).otherwise(F.col("_w.w0")))
        .drop("_w")
    )


def oversample(
    frame: DataFrame,
    keys: Sequence[str],
    label: str = "is_negative",
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Draw positives with replacement until there are as many as negatives.

    Positives are numbered by ``keys``; draw number j takes the one numbered mix(j) mod count. The
    draws are counted per number first, so each drawn row is joined once and then repeated.
    """
    sizes = frame.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).first()
    majority = frame.filter(F.col(label) == 0)
    if not sizes["pos"]:
        return majority
    minority = frame.filter(F.col(label) == 1).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_totals(minority, keys, ["_one"])
    draws = (
        frame.sparkSession.range(sizes["neg"])
        .select((seeded_mix(F.col("id"), seed) % F.lit(sizes["pos"])).alias("_one_before"))
        .groupBy("_one_before")
        .agg(F.count("*").cast("int").alias("_times"))
    )
    drawn = (
        numbered.join(draws, "_one_before")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*frame.columns)
    )
    return majority.unionByName(drawn)
