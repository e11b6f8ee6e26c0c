"""Rates and confidence bounds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two-sided 95% normal quantile.
Z95 = 1.959963984540054


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num/den, and ``empty`` when nothing was counted."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty))


def wilson(successes: Column, total: Column) -> Column:
    """Struct(value, low, high): rate and its 95% Wilson interval; zeros for an empty total."""
    n = total.cast("double")
    p = successes.cast("double") / n
    z2 = Z95 * Z95
    den = F.lit(1.0) + F.lit(z2) / n
    center = (p + F.lit(z2) / (F.lit(2.0) * n)) / den
    spread = F.lit(Z95) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n)) / den
    some = total > 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(some, p).otherwise(zero).alias("value"),
        F.when(some, F.greatest(zero, center - spread)).otherwise(zero).alias("low"),
        F.when(some, F.least(F.lit(1.0), center + spread)).otherwise(zero).alias("high"),
    )


def count_if(cond: Column) -> Column:
    """Rows where ``cond`` holds, as bigint (0 for an empty group)."""
    return F.count(F.when(cond, F.lit(1)))
