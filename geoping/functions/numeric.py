"""Numeric helpers: reproducible means, HALF_UP rounding, safe division.

``exact_mean`` accumulates in DECIMAL(18,6) (exact integer arithmetic on the
executors, compact 64-bit fast path) and divides once at the end. A plain
``avg(double)`` depends on the summation order, i.e. on how rows are split into
partitions and merged; at cluster scale the same query gives different last
bits run to run. The decimal sum is order independent, so results are the same
on 8 threads or 1000 executors. Valid for |value| < 1e12 (telemetry measures).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_TYPE = "decimal(18,6)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c: Column | str) -> Column:
    """Exact (order-independent) sum of a double column as a DECIMAL."""
    return F.sum(_c(c).cast(DECIMAL_TYPE))


def exact_mean(c: Column | str) -> Column:
    """Mean of the non-null values, order independent; null when there are none."""
    return mean_from(exact_sum(c), F.count(_c(c)))


def mean_from(decimal_sum: Column, n: Column) -> Column:
    """Mean from a mergeable (decimal sum, count) pair."""
    return F.try_divide(decimal_sum.cast("double"), n.cast("double"))


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """F32: num / den, null when den is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def percent(part: Column | str, total: Column | str) -> Column:
    """100 * part / total, null when total is 0."""
    return safe_divide(_c(part) * F.lit(100.0), total)


def zero_if_falsy(c: Column | str) -> Column:
    """Python ``x if x else 0``: null or 0 -> 0 (A02 statistics)."""
    x = _c(c)
    return F.when(x.isNull() | (x == 0), F.lit(0.0)).otherwise(x)


def null_if_falsy(c: Column | str) -> Column:
    """Python ``x if x else None``: null or 0 -> null (A09 district statistics)."""
    x = _c(c)
    return F.when(x.isNull() | (x == 0), F.lit(None).cast("double")).otherwise(x)
