"""Sharding along a Hilbert curve through several metadata dimensions.

Source and language are quantised by their share of the rows before them in code point order,
length by its logarithm; each becomes an 8-bit coordinate.  Rows are sorted by the index of the
cell on a Hilbert curve and the sorted run is cut into shards of equal row counts, so that a
file's minimum and maximum are narrow in all dimensions at once and readers prune on any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_bounded, documents, ranked, stored

SHARDS = 40
BITS = 8
# Bytes that a row's metadata counts for.
ROW_BYTES = 16


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve over ``len(coordinates)`` dimensions of ``bits`` bits.

    From the highest bit down, each dimension either reflects the first one below that bit or
    swaps with it there; a Gray code over the dimensions and an interleaving of the bits follow.
    """
    n = len(coordinates)

    def turn(acc: Column, q: Column) -> Column:
        x = [acc[f"x{i}"] for i in range(n)]
        low = q - 1
        for i in range(n):
            here = x[i].bitwiseAND(q) != 0
            swap = F.when(here, F.lit(0)).otherwise(_xor(x[0], x[i]).bitwiseAND(low))
            first = F.when(here, _xor(x[0], low)).otherwise(_xor(x[0], swap))
            if i:
                x[i] = _xor(x[i], swap)
            x[0] = first
        return F.struct(*[x[i].cast("int").alias(f"x{i}") for i in range(n)])

    start = F.struct(*[c.cast("int").alias(f"x{i}") for i, c in enumerate(coordinates)])
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def index(acc: Column) -> Column:
        x = [acc[f"x{i}"] for i in range(n)]
        for i in range(1, n):
            x[i] = _xor(x[i], x[i - 1])
        flip = reduce(_xor, [F.shiftright(x[n - 1], s) for s in range(1, bits)])
        x = [_xor(c, flip) for c in x]
        out = [
            F.shiftleft(F.shiftright(x[i], b).bitwiseAND(1).cast("long"), b * n + n - 1 - i)
            for b in range(bits)
            for i in range(n)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), out)

    return F.aggregate(steps, start, turn, index)


def _levels(narrow: DataFrame, column: str) -> DataFrame:
    """(column, level): the share of rows before a value in code point order (null last), in
    2^BITS levels.  The window runs over one row per value."""
    counts = narrow.groupBy(column).agg(F.count("*").alias("_n"))
    by_value = Window.orderBy(F.col(column).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(by_value), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    return stored(counts.select(column, F.floor(before * (1 << BITS) / total).cast("int").alias(f"_{column}_level")))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row of
    ``docs`` (doc_id, text, lang, source).

    Null texts count ``ROW_BYTES`` and have the checksum of the empty text; null sources,
    languages and ids sort as values of their own.  Rows of one cell are ordered by id, checksum
    and size; rows equal in all of these are interchangeable.  Empty input: empty result.  Fewer
    rows than shards leave shards empty.  Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = stored(
        docs.select(
            "doc_id", "lang", "source",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    total = narrow.count()
    placed = narrow
    for column in ("source", "lang"):
        levels = broadcast_bounded(_levels(narrow, column))
        placed = placed.join(levels, placed[column].eqNullSafe(levels[column])).drop(levels[column])
    length = F.least(F.lit((1 << BITS) - 1), F.floor(8 * F.log2(F.col("size").cast("double")) + 1e-9).cast("int"))
    placed = placed.withColumn("_length_level", length)
    curve = hilbert_index([F.col("_source_level"), F.col("_lang_level"), F.col("_length_level")])
    placed = placed.select("doc_id", "size", "text_crc32", curve.alias("curve"))
    order = [F.col("curve").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    in_order = ranked(placed, order, "_rank")
    shard = F.floor(F.col("_rank") * shards / F.lit(max(total, 1)))
    return in_order.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_rank") - F.ceil(F.col("shard").cast("long") * total / F.lit(shards))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` (unique doc_id) as one folder per shard, each sorted along the curve; a
    column named shard or _slot is replaced."""
    at = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.join(at, docs["doc_id"].eqNullSafe(at["_id"])).select(*[docs[c] for c in docs.columns if c not in ("shard", "_slot")], at["shard"], at["slot"].alias("_slot"))
    rows.repartition("shard").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))


def _turn(i: int) -> str:
    """One dimension's part of a step, on top of the columns x0, x1, x2 and q."""
    first = f"CASE WHEN x{i} & q <> 0 THEN xor(x0, q - 1) ELSE xor(x0, xor(x0, x{i}) & (q - 1)) END AS x0"
    own = f"CASE WHEN x{i} & q <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & (q - 1)) END AS x{i}"
    rest = [f"x{k}" for k in range(1, 3) if k != i]
    return ", ".join(["doc_id, text_crc32, size, q", first, *([own] if i else []), *rest])


_FLIP = "xor(" * 6 + "y2 >> 1" + "".join(f", y2 >> {s})" for s in range(2, BITS))
_INDEX = " + ".join(f"(((z{i} >> {b}) & 1) << {b * 3 + 2 - i})" for b in range(BITS) for i in range(3))
# 3988292384 is the reversed polynomial of CRC-32; its table follows from the rule.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT n, n AS v, 0 AS k FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
n AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, lang, source, size, xor(list_reduce(
    list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM n, crc),
ls AS (SELECT source, CAST(floor(coalesce(sum(k) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 256 / sum(k) OVER ()) AS BIGINT) AS l
  FROM (SELECT source, count(*) AS k FROM n GROUP BY source)),
ll AS (SELECT lang, CAST(floor(coalesce(sum(k) OVER (ORDER BY lang NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 256 / sum(k) OVER ()) AS BIGINT) AS l
  FROM (SELECT lang, count(*) AS k FROM n GROUP BY lang)),
step AS (
  SELECT doc_id, text_crc32, size, CAST({1 << (BITS - 1)} AS BIGINT) AS q, ls.l AS x0, ll.l AS x1, CAST(least(255, floor(8 * log2(size) + 1e-9)) AS BIGINT) AS x2
  FROM c JOIN ls ON c.source IS NOT DISTINCT FROM ls.source JOIN ll ON c.lang IS NOT DISTINCT FROM ll.lang
  UNION ALL SELECT doc_id, text_crc32, size, q >> 1, x0, x1, x2
  FROM (SELECT {_turn(2)} FROM (SELECT {_turn(1)} FROM (SELECT {_turn(0)} FROM step WHERE q > 1)))
), gray AS (SELECT doc_id, text_crc32, size, x0 AS y0, xor(x1, x0) AS y1, xor(x2, xor(x1, x0)) AS y2 FROM step WHERE q = 1),
flipped AS (SELECT doc_id, text_crc32, size, xor(y0, f) AS z0, xor(y1, f) AS z1, xor(y2, f) AS z2 FROM (SELECT *, {_FLIP} AS f FROM gray)),
curves AS (SELECT doc_id, text_crc32, size, {_INDEX} AS curve FROM flipped),
ordered AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM curves),
placed AS (SELECT *, CAST(floor(r * {SHARDS} / n) AS BIGINT) AS s FROM ordered)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INT) AS shard, CAST(r - ceil(s * n / {SHARDS}) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM placed
"""
