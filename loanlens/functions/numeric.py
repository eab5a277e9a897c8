"""Column-level numeric rules.

Two rounding rules exist in the original work and both are kept:

* ``sql_round`` - SQL ROUND on exact numerics, half away from zero.  Applied
  to decimals; ``F.round`` on a decimal is exact HALF_UP.
* ``numpy_round`` - ``Series.round`` of float64 data: scale, round half to
  even, unscale (so 0.25 -> 0.2 at one digit).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exact arithmetic type used for averages of day counts and amounts.
WIDE = T.DecimalType(38, 4)


def sql_round(c: Column, digits: int) -> Column:
    """SQL ROUND(x, d) on an exact numeric, half away from zero."""
    return F.round(c, digits)


def numpy_round(c: Column, digits: int) -> Column:
    """float64 rounding: rint(x * 10^d) / 10^d (ties to even)."""
    scale = float(10 ** digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0): null instead of a division error."""
    return num / F.nullif(den, F.lit(0))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null and NaN stay as they are."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), d).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), d)))


def nan_to_null(c: Column) -> Column:
    """NaN compares true in Spark but false in pandas; make it null."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def exact_quotient(total: Column, count: Column) -> Column:
    """total / count for a decimal total and an integer count, null on 0.

    The total is narrowed to decimal(30,4), for which Spark keeps 12 fraction
    digits in the quotient whatever the count's precision; a plain ``avg`` of
    decimal(18,4) keeps 8.  That is enough for rounding at 1-3 digits to
    agree with exact arithmetic.  Any bigint count fits the divisor.
    """
    den = F.nullif(count, F.lit(0)).cast(T.DecimalType(20, 0))
    return total.cast(T.DecimalType(30, 4)) / den


def mean_of(total: Column, count: Column, kind: T.DataType) -> Column:
    """What ``avg`` of ``kind`` values gives, from their sum and count; null on 0.

    ``avg`` of decimals keeps 4 more fraction digits; a total of 34 digits makes
    the quotient keep as many."""
    if isinstance(kind, T.DecimalType):
        total, count = total.cast(T.DecimalType(34, kind.scale)), count.cast(T.DecimalType(20, 0))
    return total / F.nullif(count, F.lit(0))


def exact_mean(x: Column, where: Column | None = None) -> Column:
    """AVG(x) [FILTER (WHERE where)] as an exact decimal; null when no row
    qualifies.  Partial-aggregatable (a sum and a count)."""
    v = x.cast(T.DecimalType(18, 4))
    if where is not None:
        v = F.when(where, v)
    return exact_quotient(F.sum(v), F.count(v))


def years_from_days(days: Column, digits: int = 1) -> Column:
    """ROUND(-days / 365.0, 1) in exact decimal arithmetic, as double."""
    return sql_round(-days.cast(WIDE) / F.lit(365).cast(T.DecimalType(3, 0)), digits).cast("double")


def int_div(a: Column, b: int) -> Column:
    """Integer division truncating toward zero (SQL `int / int`)."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))
