"""Embedding whitening: leading eigenvectors of the covariance by a matrix-free Jacobi-Davidson.

The covariance is never formed.  Its product with a few vectors, V Q = sum (x - mean) ((x - mean) Q) / n,
is one Spark job over the stored fit list, of which a few d-vectors reach the driver.  On
the driver live only d-vectors: a search space, whose Rayleigh-Ritz values and vectors approximate the
wanted pairs, the pairs that are locked, and for each pair still open the correction equation

    (I - U U') (V - theta I) (I - U U') t = -r,     U: locked vectors and the pair's own,

solved by MINRES.  All open pairs step through MINRES together, so that a step is one product,
whatever the number of pairs.  A pair is locked when its residual has reached double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SCALE = 256
COMPONENTS = 4
# Vectors that the search space starts with beyond the wanted ones, its width and MINRES steps a round.
EXTRA, WIDTH, INNER, ROUNDS = 4, 24, 10, 200
# Bytes of the fit list in one part.
PART = 4 << 20
SEED = 13
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, d, x): whole numbers floor(256 c), eight bytes each; rows out of their range go."""
    for b in batches:
        lists = b.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        fits = np.abs(flat) < 2.0**63
        whole = np.where(fits, flat, 0).astype(np.int64)
        ends = np.cumsum(lengths)
        rows, keep = [], []
        for k, (a, z) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            if fits[a:z].all():
                rows.append(whole[a:z].tobytes())
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([b.column(0).take(at), pa.array(lengths[keep], pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "d", "x"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, size: int) -> np.ndarray:
    """Sum of ``part`` (a flat array of ``size`` numbers) over blocks of rows: each task adds up its own,
    the tasks' sums are added by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += part(_matrix(b.column(0), d))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in fit.select("x").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension, through halves that can't overflow."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out = [0] * d
    for r in fit.select("x").mapInArrow(partial, "i int, high bigint, low bigint").groupBy("i").agg(*whole).collect():
        out[r.i] = (int(r.high) << 32) + int(r.low)
    return out


def minres(apply: Product, b: np.ndarray, steps: int, rtol: float) -> np.ndarray:
    """Approximate solutions of the systems A_j x_j = b_j (columns), all stepping together; a column
    that has reached ``rtol`` or broken down stands still."""
    k = b.shape[1]
    x, w0, w1, v0 = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    start = beta.copy()
    live = beta > 0
    v = b / np.where(live, beta, 1)
    eta, c0, c1, s0, s1 = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        av = apply(v)
        alpha = (v * av).sum(0)
        new = av - alpha * v - beta * v0
        norm = np.linalg.norm(new, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho1, rho2, rho3 = np.hypot(delta, norm), s1 * alpha + c0 * c1 * beta, s0 * beta
        live &= rho1 > 0
        safe = np.where(live, rho1, 1)
        c2, s2 = delta / safe, norm / safe
        w2 = (v - rho3 * w0 - rho2 * w1) / safe
        x += np.where(live, c2 * eta, 0) * w2
        eta = np.where(live, -s2 * eta, eta)
        live &= (norm > EPS * np.abs(alpha)) & (np.abs(eta) > rtol * start)
        v0, v, beta = v, np.where(live, new / np.where(norm > 0, norm, 1), 0), norm
        w0, w1, c0, c1, s0, s1 = w1, w2, c1, c2, s1, s2
    return x


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit vectors for what the columns of ``t`` add to orthonormal ``against``."""
    kept = against
    for v in t.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-10:
            v = v / size
            v = v - kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept[:, against.shape[1] :]


def jacobi_davidson(product: Product, d: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues of a symmetric operator on d-vectors."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    locked, values = np.zeros((d, 0)), []
    space = _orthonormal(rng.standard_normal((d, min(d, wanted + EXTRA))), locked)
    image = product(space)
    scale = 0.0
    for step in range(ROUNDS):
        # Rayleigh-Ritz on the search space, which is orthogonal to what is locked.
        small = space.T @ image
        ritz, y = np.linalg.eigh((small + small.T) / 2)
        ritz, y = ritz[::-1], y[:, ::-1]
        space, image = space @ y, image @ y
        scale = max([scale, *np.abs(ritz)])
        limit = 16 * EPS * np.sqrt(d) * scale
        still = min(wanted - len(values), space.shape[1])
        residual = image[:, :still] - space[:, :still] * ritz[:still]
        residual = residual - locked @ (locked.T @ residual)
        done = 0
        while done < still and np.linalg.norm(residual[:, done]) <= limit:
            done += 1
        if done:
            values += ritz[:done].tolist()
            locked = np.column_stack([locked, space[:, :done]])
            space, image, ritz, residual = space[:, done:], image[:, done:], ritz[done:], residual[:, done:]
        if len(values) == wanted:
            break
        if space.shape[1] + wanted > WIDTH:
            space, image = space[:, : wanted + EXTRA], image[:, : wanted + EXTRA]
        still = residual.shape[1]
        if still:
            theta, own = ritz[:still].copy(), space[:, :still].copy()

            def free(t: np.ndarray, own: np.ndarray = own, locked: np.ndarray = locked) -> np.ndarray:
                t = t - locked @ (locked.T @ t)
                return t - own * (own * t).sum(0)

            def correction(t: np.ndarray, theta: np.ndarray = theta, free: Product = free) -> np.ndarray:
                t = free(t)
                return free(product(t) - t * theta)

            more = minres(correction, -free(residual), INNER, max(0.5 ** (step + 2), 1e-4))
        else:
            more = rng.standard_normal((d, 1))
        basis = np.column_stack([locked, space])
        new = _orthonormal(more, basis)
        if not new.shape[1] and basis.shape[1] < d:
            new = _orthonormal(rng.standard_normal((d, 1)), basis)
        # Images are renewed as the search space is, so that rounding does not add up.
        space = np.column_stack([space, new])
        image = product(space) if not new.shape[1] or space.shape[1] <= wanted + EXTRA + 1 else np.column_stack([image, product(new)])
    else:
        raise RuntimeError(f"residuals did not reach double precision in {ROUNDS} rounds")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


@dataclass(frozen=True)
class Whitening:
    """Whole-number sums of the fit list and its leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the stored fit list (x: distinct vectors of d whole numbers); None if all
    are equal or there are none."""
    n = fit.count()
    if not n or not d:
        return None
    sums = _sums(fit, d)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(_summed(fit, lambda x: np.array([((x - mean) ** 2).sum()]), d, 1)[0] / n)
    if trace == 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()

        return _summed(fit, part, d, q.size).reshape(q.shape) / n

    values, vectors = jacobi_davidson(product, d, components)
    # Components without variance can't be scaled to one.
    kept = values > d * EPS * trace
    values, vectors = values[kept], vectors[:, kept]
    k = len(values)
    scaled = vectors / np.sqrt(values)
    middle = _summed(fit, lambda x: ((x - mean) @ scaled).sum(0), d, k) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - middle
        return (w.T @ w).ravel()

    covariance = _summed(fit, spread, d, k * k).reshape(k, k) / n
    return Whitening(n, sums, values, vectors, trace, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 over the dimensions of each row; None where it is no long."""
    top = max([int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1]) * n + max(map(abs, sums))
    if top * top * x.shape[1] < 1 << 62:
        z = n * x - np.array(sums, np.int64)
        return (z * z).sum(1).tolist()
    rough = ((x.astype(np.float64) * n - np.array([float(s) for s in sums])) ** 2).sum(1)
    out: list[int | None] = []
    for row, guess in zip(x, rough, strict=True):
        total = sum((n * v - s) ** 2 for v, s in zip(row.tolist(), sums, strict=True)) if guess < 1.0e19 else 1 << 63
        out.append(total if total < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), ``components`` rows for each
    row of ``vectors`` (vec_id, embedding).

    Entries are taken as floor(256 c); the fit is over the distinct vectors.  Rows whose vector is null,
    or holds a null, an infinite, a NaN or a value beyond a long, are left out, and so are vectors whose length
    is not the most frequent one (the greater, if two are).  Components without variance
    are left out: no rows at all if there are fewer than two different vectors.  ``deviation`` is null
    where it is no long.  Repeated rows and null ids give rows of their own; empty input gives an
    empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = stored(
        vectors.where(F.col("embedding").isNotNull() & finite)
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        .mapInArrow(_quantised, "vec_id bigint, d int, x binary")
    )
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    rows = rows.where(F.col("d") == d)
    # Many products read the fit list, so it lies in parts of a fair size whatever the table's.
    parts = max(1, -(-common["count"] * d * 8 // PART)) if common else 1
    model = fit_whitening(stored(rows.select("x").distinct().repartition(parts)), d, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    mean, scaled, k = model.mean, model.vectors / np.sqrt(model.values), len(model.values)
    explained = model.values / model.trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each), pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(projected, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
