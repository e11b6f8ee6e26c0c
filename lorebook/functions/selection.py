"""Exact order statistics per group without sorting a group or holding it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bits of a value that one round settles: histograms have at most 2 ** BITS bars a group.
BITS = 12


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(g, <name> ...): for each group the least value whose share of the group's values is at least
    ``shares[name]``, as ``percentile_disc`` has it; ``g`` is the struct of the columns ``by``.

    ``value`` is a whole number (|v| < 2 ** 61); nulls don't count, and groups of nulls only are left
    out.  Equal values are counted first.  Then every group's range is cut into at most 4,096 bars, the
    bar that holds the wanted rank is cut again, and so on until a bar is one value.
    """
    group = F.struct(F.lit(0).alias("all"), *by)
    counted = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("c")))
    whole = counted.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(str(p)).cast("decimal(9,6)") * F.col("n")).cast("bigint")).alias("rank")) for k, p in shares.items()]))
    state = cut_lineage(whole.select("g", "lo", "hi", named.alias("s")).select("g", "s.name", "s.rank", "lo", "hi", F.lit(0).cast("bigint").alias("below")))
    span = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    shift = max(0, -(-int(span or 0).bit_length() // BITS) * BITS - BITS)
    at = state.select("g", "name", "rank", "lo", "below")
    while True:
        bar = F.shiftright(F.col("v") - F.col("lo"), shift)
        bars = counted.join(at, "g").where((F.col("v") >= F.col("lo")) & (bar < 1 << BITS)).groupBy("g", "name", bar.alias("bar")).agg(
            F.sum("c").alias("c"), F.first("rank").alias("rank"), F.first("lo").alias("lo"), F.first("below").alias("below")
        )
        upto = Window.partitionBy("g", "name").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        reached = bars.withColumn("upto", F.col("below") + F.sum("c").over(upto)).where(F.col("upto") >= F.col("rank"))
        first = reached.groupBy("g", "name").agg(F.min(F.struct("bar", "rank", "lo", (F.col("upto") - F.col("c")).alias("below"))).alias("m"))
        at = cut_lineage(first.select("g", "name", "m.rank", (F.col("m.lo") + F.shiftleft(F.col("m.bar"), shift)).alias("lo"), "m.below"))
        if shift == 0:
            break
        shift -= BITS
    return at.groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("lo"))).alias(k) for k in shares])
