"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000.0
_HOUR_MICROS = 3_600_000_000.0

# Multiplicative mixing of integer ids, the same arithmetic in any SQL engine.
_MIX_MULTIPLIER = 2_654_435_761
_MIX_SEED_STEP = 2_246_822_519
_MIX_MODULUS = 4_294_967_296


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def whole(number: Column) -> Column:
    """A bigint as decimal, whose sums are exact at any size and in any order."""
    return number.cast("decimal(18,0)")


def days(micros: Column) -> Column:
    """Microseconds as fractional days.

    Totals and means are taken over microseconds and converted last: sums of whole numbers do not
    depend on the order of addition.
    """
    return micros / F.lit(_DAY_MICROS)


def days_between(start: Column | str, end: Column | str) -> Column:
    return days(micros_between(start, end))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(_HOUR_MICROS)


def year_month(moment: Column | str) -> Column:
    return F.date_format(_col(moment), "yyyy-MM")


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to a range; missing stays missing (``least``/``greatest`` alone would skip it)."""
    limited = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), limited)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, missing where the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def round_sql(value: Column, digits: int) -> Column:
    """Round a double, ties away from zero, as SQL engines do: on the binary value.

    ``round`` with digits decides ties on the decimal notation, so it turns 1.025, which is stored
    as slightly less, into 1.03.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest whole number (ties to even) and scale back, all on doubles.

    ``bround`` decides ties on the decimal notation instead, which differs for values like 5.025.
    """
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def rate(total: Column, base: Column) -> Column:
    """Quotient of two totals as double, missing where the base is zero."""
    return F.try_divide(total.cast("double"), base.cast("double"))


def tiers(value: Column, steps: Sequence[tuple[float | None, str]], strict: bool = False) -> Column:
    """Label by the first step reached (``>=``, or ``>`` if strict); a ``None`` step takes the rest."""
    result = None
    for bound, label in steps:
        if bound is None:
            return F.lit(label) if result is None else result.otherwise(F.lit(label))
        reached = value > bound if strict else value >= bound
        result = F.when(reached, label) if result is None else result.when(reached, label)
    return result


def on_time_flag(margin: Column) -> Column:
    """1 when delivered on or before the estimate, else 0; an unknown margin counts as late."""
    return F.when(margin >= 0, F.lit(1)).otherwise(F.lit(0))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside a lambda the optimizer may replace a column by its definition, which would then be
    computed for every array element; a lambda variable is never replaced.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seeded_mix(value: Column, seed: int) -> Column:
    """Pseudo-random order key in [0, 2**32) for an integer column, fixed by ``seed``."""
    # The product can exceed the bigint range, so it is taken as decimal.
    reduced = F.pmod(value.cast("bigint"), F.lit(_MIX_MODULUS)).cast("decimal(10,0)")
    product = reduced * F.lit(_MIX_MULTIPLIER).cast("decimal(10,0)")
    return F.pmod(
        product + F.lit(seed * _MIX_SEED_STEP % _MIX_MODULUS).cast("decimal(10,0)"), F.lit(_MIX_MODULUS).cast("decimal(10,0)")
    ).cast("bigint")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
