"""Exact ranks, medians and running totals without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sellerscope.session import stage

# A quantile sketch of a range is off by this part of its rows at most, so a step keeps about 1 / 2,000 of them.
ACCURACY = 10_000
# Rows of one range whose distinct values are listed in one task at most, unless they are all equal.
MAX_LISTED_ROWS = 1_000_000


@dataclass
class _Search:
    """Where the value of one wanted rank lies: in [low, high], with ``below`` rows before it."""

    column: int
    rank: int
    low: float
    high: float
    below: int
    inside: int

    def open(self) -> bool:
        return self.inside > MAX_LISTED_ROWS and self.low < self.high


@dataclass(frozen=True)
class Ranked:
    """A value with the rows that sort before it and the rows equal to it."""

    value: object
    before: int
    equal: int


def _cells(df: DataFrame, columns: Sequence[Column], kind: str) -> DataFrame:
    """One (column number, value) row per value present."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), c.cast(kind).alias("v")) for i, c in enumerate(columns)]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.i", "cell.v").filter("v IS NOT NULL")


def _extents(df: DataFrame, columns: Sequence[Column], kind: str) -> list[tuple[int, float, float]]:
    """Number of values present, least and greatest value of every column: one row, from the columns as they stand."""
    figures = []
    for i, c in enumerate(columns):
        value = c.cast(kind)
        number = value.cast("double")
        figures += [F.count(value).alias(f"rows_{i}"), F.min(number).alias(f"low_{i}"), F.max(number).alias(f"high_{i}")]
    found = df.agg(*figures).first()
    return [(found[f"rows_{i}"], found[f"low_{i}"], found[f"high_{i}"]) for i in range(len(columns))]


class _Ranges:
    """The open ranges of every column, as expressions that look them up by column number."""

    def __init__(self, searches: list[_Search], columns: int):
        self.by_column: list[list[tuple[float, float]]] = [[] for _ in range(columns)]
        for search in searches:
            held = self.by_column[search.column]
            if (search.low, search.high) not in held:
                held.append((search.low, search.high))
        self.width = max(len(held) for held in self.by_column)

    def slot_of(self, search: _Search) -> int:
        held = self.by_column[search.column]
        return search.column * self.width + held.index((search.low, search.high))

    def bounds(self, place: int) -> tuple[Column, Column]:
        """Low and high end of the range at ``place`` of the row's column, missing if there is none."""
        picked = [held[place] if place < len(held) else (None, None) for held in self.by_column]
        low, high = (
            F.get(F.array(*[F.lit(pair[end]).cast("double") for pair in picked]), F.col("i"))
            for end in (0, 1)
        )
        return low, high

    def slots(self) -> Column:
        """Number of the range a cell lies in. Ranges of one column are equal or disjoint."""
        number, slot = F.col("v").cast("double"), None
        for place in range(self.width):
            low, high = self.bounds(place)
            name = F.col("i") * self.width + place
            inside = (number >= low) & (number <= high)
            slot = F.when(inside, name) if slot is None else slot.when(inside, name)
        return slot


def _brackets(cells: DataFrame, searches: list[_Search], ranges: _Ranges) -> dict[int, list[tuple[float, float]]]:
    """One pass: disjoint value ranges by slot that a quantile sketch finds around the wanted ranks.

    Every partition makes one sketch for each slot; sketches merge, and their error is a share of the rows.
    """
    near = {}
    for number, search in enumerate(searches):
        share = (search.rank - search.below) / search.inside
        low, high = math.floor(share * ACCURACY) - 2, math.ceil(share * ACCURACY) + 2
        near[number] = (max(low, 0) / ACCURACY, min(high, ACCURACY) / ACCURACY)
    shares = sorted({share for pair in near.values() for share in pair})
    sketch = F.percentile_approx(F.col("v").cast("double"), shares, ACCURACY)
    found = {
        row["slot"]: dict(zip(shares, row["values"]))
        for row in cells.withColumn("slot", ranges.slots())
        .filter("slot IS NOT NULL")
        .groupBy("slot")
        .agg(sketch.alias("values"))
        .collect()
    }  # one row per range, a few values per wanted rank
    brackets: dict[int, list[tuple[float, float]]] = {}
    for number, search in enumerate(searches):
        slot = ranges.slot_of(search)
        brackets.setdefault(slot, []).append(tuple(found[slot][share] for share in near[number]))
    for slot, held in brackets.items():
        apart: list[tuple[float, float]] = []
        for low, high in sorted(held):
            if apart and low <= apart[-1][1]:
                apart[-1] = (apart[-1][0], max(high, apart[-1][1]))
            else:
                apart.append((low, high))
        brackets[slot] = apart
    return brackets


def _part(brackets: dict[int, list[tuple[float, float]]], slots: int) -> Column:
    """Number of the part a cell lies in: before, on the ends of, inside or after the brackets of its slot."""
    number, part = F.col("v").cast("double"), F.lit(0)
    for place in range(max(len(held) for held in brackets.values())):
        pairs = [
            held[place] if place < len(held := brackets.get(slot, [])) else (None, None) for slot in range(slots)
        ]
        low, high = (
            F.get(F.array(*[F.lit(pair[end]).cast("double") for pair in pairs]), F.col("slot")) for end in (0, 1)
        )
        for passed in (number >= low, number > low, number >= high, number > high):
            part = part + F.when(passed, 1).otherwise(0)
    return part


def _narrow(cells: DataFrame, searches: list[_Search], columns: int) -> None:
    """Two passes: bracket every wanted rank by a sketch, then count the parts exactly and step into the wanted one.

    The ends of a bracket are values of the data and parts of their own, so every step shortens a range even where the
    sketch is off, and a value that most rows share is found at once.
    """
    ranges = _Ranges(searches, columns)
    number = F.col("v").cast("double")
    brackets = _brackets(cells, searches, ranges)
    counted = (
        cells.withColumn("slot", ranges.slots())
        .filter("slot IS NOT NULL")
        .groupBy("slot", _part(brackets, columns * ranges.width).alias("part"))
        .agg(F.count("*").alias("rows"), F.min(number).alias("low"), F.max(number).alias("high"))
        .collect()
    )  # at most four rows per wanted rank and one more per range
    for search in searches:
        slot, below = ranges.slot_of(search), search.below
        for row in sorted((b for b in counted if b["slot"] == slot), key=lambda b: b["part"]):
            if below + row["rows"] > search.rank:
                search.low, search.high = row["low"], row["high"]
                search.below, search.inside = below, row["rows"]
                break
            below += row["rows"]


def _listed(cells: DataFrame, searches: list[_Search], columns: int) -> list[Ranked]:
    """Last pass: list the distinct values of the final ranges and pick by running count."""
    ranges = _Ranges(searches, columns)
    counted = (
        cells.withColumn("slot", ranges.slots())
        .filter("slot IS NOT NULL")
        .groupBy("slot", "v")
        .agg(F.count("*").alias("rows"))
    )
    order = Window.partitionBy("slot").orderBy("v")
    running = counted.withColumn("before", F.sum("rows").over(order) - F.col("rows"))
    offsets: list[list[int]] = [[] for _ in range(columns * ranges.width)]
    for search in searches:
        offsets[ranges.slot_of(search)].append(search.rank - search.below)
    wanted = F.get(
        F.array(*[F.array(*[F.lit(o).cast("bigint") for o in each]).cast("array<bigint>") for each in offsets]),
        F.col("slot"),
    )
    first, last = F.col("before"), F.col("before") + F.col("rows")
    picks = running.filter(F.exists(wanted, lambda o: (first <= o) & (o < last))).collect()
    found = []  # the picks are one row per wanted rank at most
    for search in searches:
        slot, offset = ranges.slot_of(search), search.rank - search.below
        row = next(
            p for p in picks
            if p["slot"] == slot and p["before"] <= offset < p["before"] + p["rows"]
        )
        found.append(Ranked(row["v"], search.below + row["before"], row["rows"]))
    return found


def values_at(
    df: DataFrame, columns: Sequence[Column], ranks, kind: str = "double"
) -> list[list[Ranked]]:
    """Exact order statistics of several numeric columns (missing values left out).

    ``ranks`` maps the number of non-missing rows of a column to the wanted 0-based ranks. While the
    range of a rank holds many rows, a quantile sketch brackets it and the bracket's rows are
    counted; when few rows are left their distinct values are listed. Two passes do up to
    ``MAX_LISTED_ROWS``, four up to about 2,000 times as many, however the values are spread.
    Nothing is shuffled but sketches, counts and the listed values.
    """
    cells = _cells(df, columns, kind)
    extent = _extents(df, columns, kind)
    searches: list[_Search] = []
    for i, (rows, low, high) in enumerate(extent):
        searches += [_Search(i, rank, low, high, 0, rows) for rank in (ranks(rows) if rows else ())]
    while pending := [s for s in searches if s.open()]:
        _narrow(cells, pending, len(columns))
    result: list[list[Ranked]] = [[] for _ in columns]
    if searches:
        for search, ranked in zip(searches, _listed(cells, searches, len(columns))):
            result[search.column].append(ranked)
    return result


def _middle(rows: int) -> list[int]:
    return [(rows - 1) // 2, rows // 2]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column; the two middle values of an even count are averaged."""
    found = values_at(df, [F.col(c) for c in columns], _middle)
    return {
        name: (middle[0].value + middle[1].value) / 2 if middle else None
        for name, middle in zip(columns, found)
    }


def sorts_before(df: DataFrame, keys: Sequence[Column], position: int) -> Column:
    """Predicate that holds for exactly the first ``position`` rows of ``df`` ordered by ``keys``.

    The keys are bigint expressions without missing values that together identify a row. Each key
    is only consulted among rows tied on the ones before it, so the cut is a plain filter that
    needs no sort. Rows equal in all keys are never separated; they all come before the cut.
    """
    if position <= 0:
        return F.lit(False)
    before, tied, left = F.lit(False), F.lit(True), position
    for key in keys:
        found = values_at(df.filter(tied), [key], lambda rows, r=left: [min(r, rows - 1)], "bigint")
        ranked = found[0][0]
        left -= ranked.before
        boundary = F.lit(ranked.value)
        before = before | (tied & (key < boundary))
        tied = tied & (key == boundary)
        if left == 0:
            return before
    return before | tied


def running_totals(df: DataFrame, order_by: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Add ``<name>_before`` columns: the total of ``name`` over all rows sorted ahead of a row.

    Rows are range-partitioned by unique sort keys and written, which fixes the partition of every
    row. Totals per partition give the offsets; the rest is a window inside each partition.
    """
    names = list(order_by)
    ranged = df.repartitionByRange(*names).withColumn("_range", F.spark_partition_id())
    fixed = stage(ranged, "ranges")
    per_range = fixed.groupBy("_range").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    # One row per shuffle partition, so this window is bounded by the session's setting.
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{t}").over(ahead), F.lit(0)).alias(f"_off_{t}") for t in totals],
    )
    inside = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    local = fixed.select(
        "*",
        *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_in_{t}") for t in totals],
    )
    return local.join(F.broadcast(offsets), "_range").select(
        *df.columns,
        *[(F.col(f"_off_{t}") + F.col(f"_in_{t}")).alias(f"{t}_before") for t in totals],
    )
