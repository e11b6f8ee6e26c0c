"""Embedding near-duplicates from randomly rotated binary codes with correction factors.

Vectors are normalised and rotated at random.  Stored per vector: the signs of its rotated
coordinates (the code), the factor <sign / sqrt(d), x> that makes the code's inner products
unbiased, and eight bits a coordinate with the length of their rounding error.

Candidates.  Bits of several rotations are cut into bands; vectors that agree in a band meet.
Bits in a band follow the number of vectors and the number of bands follows from the share
(``RECALL``) of pairs just at the limit that have to meet, so buckets don't grow with the
input.  A bucket above ``BLOCK`` vectors is dealt in blocks, each pair of blocks a task's group.
A pair is judged in its first common band only.

Decisions.  1. The code's unbiased estimate, with a confidence bound, drops most pairs.  2. The
rounded coordinates bound the cosine strictly: above the limit a pair is linked, below it is
not.  3. What is left undecided is recomputed from the whole vectors in double precision.
Links are counted where they are found and only a spanning forest of them is passed on.
Equal vectors are one vector with a weight throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_bounded, connected_components, stored

LIMIT = 0.9
RECALL = 0.99
# Vectors of a bucket that meet in one group come from two blocks of about this many.
BLOCK = 1_000
# Standard deviations of the code's estimate that a pair may lie below the limit.
CONFIDENCE = 4.0
SEED = 20


def bands_for(vectors: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a band, bands) for so many vectors."""
    bits = max(8, math.ceil(math.log2(max(vectors, 2))) - 3)
    meet = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def band_keys(x: np.ndarray, bits: int, bands: int, seed: int = SEED) -> np.ndarray:
    """(rows, bands) unsigned keys from the signs of as many rotations as it takes."""
    d = x.shape[1]
    rounds = math.ceil(bits * bands / d)
    signs = np.concatenate([x @ rotation(d, seed + k).T >= 0 for k in range(rounds)], 1)[:, : bits * bands]
    return signs.reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.uint64))


def encode(x: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: rounded rotated coordinates (int8), their unit, the code's factor, and the
    length of the rounding error.  The code is the sign of the rounded coordinates."""
    d = x.shape[1]
    y = x @ rotation(d, seed).T
    unit = np.abs(y).max(1) / 127
    rounded = np.rint(y / unit[:, None]).astype(np.int8)
    factor = (np.where(rounded >= 0, y, -y)).sum(1) / math.sqrt(d)
    error = np.linalg.norm(y - rounded * unit[:, None], axis=1) + 1e-12
    return rounded, unit, factor, error


def judge(rounded, unit, factor, error, pairs, limit: float = LIMIT, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(linked, undecided) for pairs (i, j) of encoded vectors."""
    i, j = pairs
    d = rounded.shape[1]
    near = rounded.astype(np.float32) * unit[:, None].astype(np.float32)
    code = np.where(rounded >= 0, np.float32(1 / math.sqrt(d)), np.float32(-1 / math.sqrt(d)))
    # Unbiased estimate of <x_i, x_j> from the code of i and the coordinates of j.
    rough = np.einsum("nd,nd->n", code[i], near[j]) / factor[i]
    spread = np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / factor[i] / math.sqrt(max(d - 1, 1))
    able = np.flatnonzero(rough + confidence * spread * math.sqrt(1 - limit * limit) + 2 * error[j] / factor[i] >= limit)
    i, j = i[able], j[able]
    fine = np.einsum("nd,nd->n", rounded[i].astype(np.float64), rounded[j].astype(np.float64)) * unit[i] * unit[j]
    slack = error[i] * (1 + error[j]) + error[j] * (1 + error[i]) + error[i] * error[j] + 1e-9
    sure = np.zeros(len(pairs[0]), bool)
    open_ = np.zeros(len(pairs[0]), bool)
    sure[able] = fine - slack >= limit
    open_[able] = (fine - slack < limit) & (fine + slack >= limit)
    return sure, open_


def _encoder(bits: int, bands: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                x /= np.abs(x).max(1)[:, None]  # so that squares neither vanish nor overflow
                x /= np.linalg.norm(x, axis=1)[:, None]
                rounded, unit, factor, error = encode(x)
                keys = band_keys(x, bits, bands)
                take = pa.array(at)
                yield pa.record_batch(
                    [
                        b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(at), d), pa.int32()),
                        pa.array([r.tobytes() for r in rounded], pa.binary()), pa.array(unit), pa.array(factor), pa.array(error),
                        pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["cid", "weight", "d", "rounded", "unit", "factor", "error", "keys"],
                )

    return encoded


def _group_links(g: pa.Table) -> tuple[list, list]:
    """Counts and forest of one group's sure links, and its undecided pairs."""
    m = len(g)
    first = g.column("d")[0].as_py()
    band = g.column("band")[0].as_py()
    cid, weight = g.column("cid").to_numpy(), g.column("weight").to_numpy()
    rounded = np.frombuffer(b"".join(g.column("rounded").to_pylist()), np.int8).reshape(m, first)
    unit, factor, error = (g.column(c).to_numpy() for c in ("unit", "factor", "error"))
    keys = np.array(g.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(m, -1)[:, :band]
    block, low, high = g.column("block").to_numpy(), g.column("low")[0].as_py(), g.column("high")[0].as_py()
    counts, parent = np.zeros(m, np.int64), list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    undecided, step = [], max(1, 200_000 // m)
    for at in range(0, m, step):
        i, j = np.meshgrid(np.arange(at, min(at + step, m)), np.arange(m), indexing="ij")
        meet = (i < j) if low == high else (block[i] != block[j]) & (i < j)
        i, j = i[meet], j[meet]
        if not len(i):
            continue
        if band:  # pairs that met in an earlier band were judged there
            new = ~(keys[i] == keys[j]).any(1)
            i, j = i[new], j[new]
        sure, open_ = judge(rounded, unit, factor, error, (i, j))
        a, b = i[sure], j[sure]
        np.add.at(counts, a, weight[b])
        np.add.at(counts, b, weight[a])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        undecided += zip(cid[i[open_]].tolist(), cid[j[open_]].tolist(), strict=True)
    found = [(int(cid[x]), int(cid[root(x)]), int(counts[x])) for x in np.flatnonzero(counts)]
    return found, undecided


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups stand together (rows are sorted by them); one group is held at a time."""
    names = ["d", "band", "key", "low", "high"]

    def out(groups: list[pa.Table]) -> pa.RecordBatch:
        rows = []
        for g in groups:
            if len(g) > 1:
                found, undecided = _group_links(g)
                rows += [(*f, False) for f in found] + [(*u, 0, True) for u in undecided]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["a", "b", "n", "open"])

    held: list[pa.Table] = []
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        ids = np.stack([t.column(c).to_numpy().astype(np.int64) for c in names])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), len(t)]
        done = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            now = tuple(ids[:, a])
            if now != last and held:
                done.append(pa.concat_tables(held))
                held = []
            held.append(t.slice(a, z - a))
            last = now
        yield out(done)
    if held:
        yield out([pa.concat_tables(held)])


def near_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Null or zero vectors and such with null, infinite or NaN components link with nothing; vectors
    of different lengths neither.  Equal vectors are linked with each other.  ``component_id`` is
    the least non-null id within reach (null if there is none).  Repeated rows count as rows.
    Empty input: empty result.  Other columns are not read.
    """
    if limit != LIMIT:
        raise ValueError("judge() is fixed to LIMIT")
    rows = vectors.select("vec_id", "embedding")
    fine = F.coalesce(
        F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    valid = rows.where(fine)
    classes = stored(
        valid.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    bits, bands = bands_for(classes.count(), limit)
    codes = stored(
        classes.select("cid", "weight", "embedding").mapInArrow(
            _encoder(bits, bands),
            "cid bigint, weight bigint, d int, rounded binary, unit double, factor double, error double, keys array<bigint>",
        )
    )
    met = codes.select("*", F.posexplode("keys").alias("band", "key"))
    hot = stored(
        codes.select("d", F.posexplode("keys").alias("band", "key")).groupBy("d", "band", "key").count()
        .where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
        .select("d", "band", "key", "blocks")
    )
    dealt = (
        met.join(broadcast_bounded(hot), ["d", "band", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    groups = ["d", "band", "key", "low", "high"]
    found = stored(
        dealt.select(*groups, "block", "cid", "weight", "rounded", "unit", "factor", "error", "keys")
        .repartition(*[F.col(g) for g in groups]).sortWithinPartitions(*groups)
        .mapInArrow(_judged, "a bigint, b bigint, n bigint, open boolean")
    )
    # Undecided pairs: cosines in double precision from the whole vectors.
    x = classes.select(F.col("cid").alias("a"), F.col("embedding").alias("_x"), F.col("weight").alias("_wa"))
    y = classes.select(F.col("cid").alias("b"), F.col("embedding").alias("_y"), F.col("weight").alias("_wb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    exact = stored(
        found.where("open").select("a", "b").distinct().join(x, "a").join(y, "b")
        .where(dot("_x", "_y") / (F.sqrt(dot("_x", "_x")) * F.sqrt(dot("_y", "_y"))) >= limit)
        .select("a", "b", "_wa", "_wb")
    )
    counts = (
        found.where("not open").select(F.col("a").alias("cid"), "n")
        .union(exact.select("a", "_wb")).union(exact.select("b", "_wa"))
        .groupBy("cid").agg(F.sum("n").alias("n"))
    )
    roots = connected_components(found.where("not open").select("a", "b").union(exact.select("a", "b")))
    rooted = classes.select("cid", "first_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = stored(
        rooted.join(least, "root").join(counts, "cid", "left").select("cid", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    )
    of = classes.select("cid", F.col("embedding").alias("_e"), "weight").join(by_class, "cid")
    linked = valid.join(of, F.col("embedding") == F.col("_e")).select(
        "vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_rabitq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
