"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies, tilted towards the longer documents of its
source.  Its whole part is allocated for certain; the rest is an inclusion probability p, and
documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), with u
a hash of the identity.  The lowest ranks are taken until the source's size is reached, so
that the sample has a fixed size (in words) although the probabilities differ.

Plan: one narrow pass over the texts (stored), small aggregates per source, then one pass that
compares each document with its source's cut.  A cut is found in two levels: ``RANGES`` ranges
of the rank per source are summed first, and only the range that holds the cut is sorted, so a
source with a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_bounded, documents, fresh, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
RANGES = 4096
# Tilts are kept as whole ten-thousandths: sums of them don't depend on their order.
UNIT = 10_000


def source_targets(narrow: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: (source, source_size, n_docs, target).

    Sources in code point order, null last, weigh ``weights``, repeating.  They share
    ``percent`` of all words; a target above ``most`` times its source's size is cut to that
    and the excess reshared by weight.  With sources sorted by the level at which they reach
    their limit, the limited ones are a prefix, so the common level needs one running sum.
    The windows run over one row per source.
    """
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = per.withColumn("_w", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    limit = F.lit(most) * F.col("source_size")
    by_limit = Window.orderBy((limit / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * percent / 100 - F.coalesce(F.sum(limit).over(upto), F.lit(0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0))
    )
    free = F.min(F.when(F.col("_level") * F.col("_w") <= limit, F.struct("_rank", "_level"))).over(whole)["_level"]
    levelled = weighed.withColumn("_rank", F.row_number().over(by_limit)).withColumn("_level", level)
    at = levelled.withColumn("_free", free)
    target = F.when(F.col("_free").isNull() | (F.col("_free") * F.col("_w") >= limit), limit.cast("double")).otherwise(F.col("_free") * F.col("_w"))
    return at.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(*keys: str, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the row's identity and the seed only:
    the first 52 bits of the MD5 of the keys (null as '-') and the seed."""
    words = [F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws(":", *words, F.lit(str(seed))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_mix(docs: DataFrame, seed: int = 7, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    Null and empty texts have size 0 and are not copied.  Rows that agree in doc_id, source and
    size tie and are taken together; a null doc_id is an id like any other.  ``copies`` is
    0 .. ``most``; ``taken`` = copies x size.  Empty input: empty result.  Other columns are
    not read.
    """
    narrow = stored(docs.select("doc_id", "source", word_count("text").alias("size")))
    per = stored(source_targets(narrow, weights, percent, most))

    # Tilt: size / (size + mean size), in whole ten-thousandths; its mean over words is at least a
    # half, so tilt / mean - 1 lies in [-1, 1] and the expected copies in [0, most].
    sized = narrow.where("size > 0").join(broadcast_bounded(per), narrow["source"].eqNullSafe(per["source"])).drop(per["source"])
    mean = F.ceil(F.col("source_size") / F.col("n_docs"))
    tilt = F.floor(F.col("size") * UNIT / (F.col("size") + mean))
    tilts = stored(
        sized.groupBy("source").agg(
            F.first("source_size").alias("source_size"), F.first("n_docs").alias("n_docs"), F.first("target").alias("target"),
            (F.sum((tilt * F.col("size")).cast("decimal(38,0)")).cast("double") / F.first("source_size")).alias("_mean_tilt"),
        )
    )
    ratio = F.col("target") / F.col("source_size")
    swing = F.least(ratio, F.lit(most) - ratio)
    bias = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tilt / F.col("_mean_tilt") - 1))
    expected = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), ratio + swing * bias))
    u = _uniform("doc_id", "size", seed=seed)
    p = F.col("_expected") - F.col("_certain")
    # Order statistic q = odds(u) / odds(p); q / (1 + q) puts it into (0, 1) for the ranges.
    drawn = (
        narrow.where("size > 0").join(broadcast_bounded(tilts), narrow["source"].eqNullSafe(tilts["source"])).drop(tilts["source"])
        .withColumn("_expected", expected)
        .withColumn("_certain", F.floor("_expected"))
        .withColumn("_q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
        .withColumn("_range", F.floor(F.col("_q") / (1 + F.col("_q")) * RANGES).cast("int"))
        .withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
        .select("doc_id", "_id", "source", "size", "source_size", "target", "_certain", "_q", "_range")
    )
    drawn = stored(drawn)

    # Level 1: words by range; the range in which the source's remaining words run out.
    ranges = drawn.groupBy("source", "_range").agg(
        F.sum(F.when(F.col("_range").isNotNull(), F.col("size")).otherwise(0)).alias("_words"),
        F.sum(F.col("_certain") * F.col("size")).alias("_sure"), F.first("target").alias("target"),
    )
    in_source = Window.partitionBy("source")
    running = in_source.orderBy(F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        ranges.withColumn("_left", F.col("target") - F.sum("_sure").over(in_source))
        .withColumn("_upto", F.sum("_words").over(running))
        .where(F.col("_range").isNotNull() & (F.col("_upto") - F.col("_words") < F.col("_left")))
        .groupBy("source").agg(F.max(F.struct("_range", (F.col("_left") - (F.col("_upto") - F.col("_words"))).alias("_left"))).alias("_c"))
        .select("source", F.col("_c._range").alias("_cut_range"), F.col("_c._left").alias("_left"))
    )
    crossing = broadcast_bounded(stored(crossing))
    # Level 2: inside that range, the last document that brings the sum nearer to the target.
    edge = drawn.join(crossing, drawn["source"].eqNullSafe(crossing["source"]) & (F.col("_range") == F.col("_cut_range"))).drop(crossing["source"])
    order = Window.partitionBy("source").orderBy("_q", "_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        edge.withColumn("_sum", F.sum("size").over(order))
        .where(F.col("_sum") - F.col("size") / 2 <= F.col("_left"))
        .groupBy("source").agg(F.max(F.struct("_q", "_id", "size")).alias("_cut"))
    )
    limits = stored(
        crossing.alias("c").join(cuts.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source")), "left")
        .select(F.col("c.source").alias("source"), "_cut_range", "_cut")
    )
    picked = drawn.join(broadcast_bounded(limits), drawn["source"].eqNullSafe(limits["source"]), "left").drop(limits["source"])
    extra = F.when(F.col("_range") < F.col("_cut_range"), 1).when(
        (F.col("_range") == F.col("_cut_range")) & (F.struct("_q", "_id", "size") <= F.col("_cut")), 1
    ).otherwise(0)
    copies = (F.col("_certain") + F.coalesce(extra, F.lit(0))).cast("int")
    taken = picked.select("doc_id", "size", "source_size", "target", copies.alias("copies"))
    none = narrow.where("size = 0").join(broadcast_bounded(per), narrow["source"].eqNullSafe(per["source"])).select("doc_id", "size", "source_size", "target", F.lit(0).alias("copies"))
    return taken.union(none).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_by_copies(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``mix`` (doc_id, copies) says, by null-safe doc_id; where
    rows share an id, each of them takes the largest number given for it.  Columns of ``docs`` are kept
    whatever their names; an empty table or mix gives an empty result."""
    key, copies, k = (fresh(docs, name) for name in ("key", "copies", "k"))
    times = mix.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    kept = docs.join(times, docs["doc_id"].eqNullSafe(times[key]))
    return kept.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = f"""
WITH n AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM n GROUP BY source),
weighed AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM per),
levelled AS (SELECT *, row_number() OVER o AS r,
    (sum(source_size) OVER () * {SHARE_PERCENT} / 100e0 - coalesce(sum({MOST_COPIES} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY {MOST_COPIES} * source_size / w, source NULLS LAST)),
freed AS (SELECT *, arg_min(level, r) FILTER (level * w <= {MOST_COPIES} * source_size) OVER () AS free FROM levelled),
targets AS (SELECT source, source_size, n_docs,
    CASE WHEN free IS NULL OR free * w >= {MOST_COPIES} * source_size THEN CAST({MOST_COPIES} * source_size AS DOUBLE) ELSE free * w END AS target FROM freed),
tilted AS (SELECT n.doc_id, n.size, t.*, CAST(floor(size * {UNIT} / (size + ceil(source_size / n_docs))) AS BIGINT) AS tilt
  FROM n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source),
means AS (SELECT source, CAST(sum(tilt * size) AS DOUBLE) / any_value(source_size) AS mean_tilt FROM tilted WHERE size > 0 GROUP BY source),
expected AS (SELECT t.*, greatest(0e0, least({MOST_COPIES}e0, target / source_size
      + least(target / source_size, {MOST_COPIES} - target / source_size) * greatest(-1e0, least(1e0, tilt / mean_tilt - 1)))) AS e,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size || ':7'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM tilted t JOIN means m ON t.source IS NOT DISTINCT FROM m.source WHERE size > 0),
odds AS (SELECT *, floor(e) AS certain, CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM expected),
sums AS (SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS remaining,
    sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, coalesce(doc_id, -9223372036854775808), size
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM odds),
copies AS (SELECT doc_id, size, source_size, target, CAST(certain + CASE WHEN q IS NOT NULL AND upto - size / 2 <= remaining THEN 1 ELSE 0 END AS INT) AS copies FROM sums
  UNION ALL SELECT doc_id, size, source_size, target, 0 FROM tilted WHERE size = 0)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copies
"""
