"""Exact row numbers that never sort one whole group inside a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    """``row_number`` over (keys, order), computed inside small (keys, bucket) groups.

    ``bucket`` must be non-decreasing in the order, e.g. the minute of the leading timestamp.
    Bucket sizes are counted (combined map-side), turned into offsets by a window over bucket
    counts, and added to the rank inside each bucket, so a hot key spreads over its buckets.
    """
    keys = list(keys)
    tagged = df.withColumn("_b", bucket)
    sizes = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    ranked = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        ranked.alias("l").join(offsets.alias("r"), cond)
        .select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_rn") + F.col("_off")).alias(out))
    )


def sorted_places(df: DataFrame, order_col: str) -> DataFrame:
    """``df`` sorted along a unique column by ranges, with ``_part`` (the range) and ``_place`` inside it.

    The sorted rows are stored, so the places can't move.  Ranges are as many as the sort has
    partitions, so they grow with the data and no task sees more than one of them.
    """
    placed = cut_lineage(df.orderBy(order_col).withColumn("_m", F.monotonically_increasing_id()))
    return placed.select(*df.columns, F.shiftrightunsigned("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_place"))


def range_offsets(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, <name> ...): the aggregates of all ranges before; one row per range."""
    totals = placed.groupBy("_part").agg(*[c.alias(name) for name, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])


def distributed_row_number(df: DataFrame, order_col: str, out: str) -> DataFrame:
    """``row_number`` by a unique column over the whole table."""
    placed = sorted_places(df, order_col)
    offsets = range_offsets(placed, {"_off": F.count("*")})
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_off") + F.col("_place") + 1).alias(out))
