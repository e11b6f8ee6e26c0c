"""Intermediate tables in the shared folder, global ranks, and connected components.

All of it is DataFrame code.  Tables that are ``stored`` survive lost executors: they are Parquet
files below ``spark.checkpoint.dir``, which every executor and the driver can read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as stored
from ..session import settled

__all__ = ["broadcast_bounded", "connected_components", "documents", "few_rows", "fresh", "ranked", "settled", "stored", "word_count"]

# Largest table (rows of a few narrow columns) that may be sent to every executor.
BROADCAST_ROWS = 100_000
# Words are maximal runs of anything but ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def broadcast_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table only if it has at most ``rows`` rows; beyond that adaptive
    execution picks a shuffled join and splits its skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows, so that what a task makes of one batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def word_count(text: str) -> Column:
    """Number of words of a whole text (null: 0), without building an array of them."""
    marked = F.regexp_replace(F.col(text), f"{SPACE}*+{NOT_SPACE}++", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, f"{SPACE}++", "")), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """``df`` with its 0-based rank in a total order, computed by a range-partitioned sort.

    No task sees more than one range: the rank is the row's place in its sorted partition
    plus the sizes of the partitions before it (one row per partition, the only table that
    is broadcast).  The sorted rows are stored, so that the places can't move later.
    """
    place = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        place.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_place", "_before")
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternating large-star and small-star steps, each one aggregate and one join; only the
    edge table is carried, and every step is stored.  Raises if ``rounds`` do not suffice
    (they grow with the logarithm of the longest chain).
    """
    e = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    if e.isEmpty():
        return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for _ in range(rounds):
        # Large star: every larger neighbour of x is linked to the least of x's neighbourhood.
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: x and its smaller neighbours are linked to the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.*").where(F.col("v") != F.col("u")).distinct()
        )
        new = stored(small)
        # Stars only, and no root is anyone's leaf: done.
        roots = new.select(F.col("u").alias("v")).distinct()
        one_parent = new.groupBy("v").count().where(F.col("count") > 1).isEmpty()
        e = new
        if one_parent and new.join(roots, "v", "left_semi").isEmpty():
            nodes = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return nodes.union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
