"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, low: float, high: float, invert: bool = False) -> Column:
    """``x`` scaled from [low, high] to [0, 1]; an unknown counts as 1 (0 if inverted)."""
    if low == high:
        return F.lit(0.5)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return 1 - unit if invert else unit


def steps(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first true condition."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def truthy(x: Column) -> Column:
    """Known and not zero."""
    return x.isNotNull() & (x != 0)


def safe_number(x: Column, decimals: int) -> Column:
    """``x`` as a rounded double; null where it is not a finite number."""
    number = x.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), F.round(number, decimals))


def safe_integer(x: Column) -> Column:
    """``x`` cut to a whole number; null where it is no finite number or beyond 10**15 either way."""
    number = x.try_cast("double")
    whole = F.when(F.abs(number) < 1e16, number.cast("long"))  # null for no number and for infinities
    return F.when(~F.isnan(number) & (F.abs(whole) <= 10**15), whole)


def percent(now: Column, then: Column) -> Column:
    return F.try_divide((now - then), then) * 100
