"""Exact cosine search: vectors in cells around pivots, and bounds that say which cells a query has to visit.

Angles between unit vectors are a metric.  Every vector belongs to the cell of its nearest pivot, and a
cell knows the least and the greatest angle of its members to the pivot; so the angle of a query to
any of them is at least its own distance from that ring.  A query first visits its nearest cell.  Its
k-th best score there, or the floor, then rules out all cells whose best possible score is lower, and
it visits the others.  Results are exact, ties included, whatever the pivots.

Both sides stay on Spark: a visit is a row, and one task's group is a block of at most about ``BLOCK``
vectors of one cell with its share of the visiting queries, which stream past it.  Where bounds rule out little, a
query is shuffled once for each cell and a vector once for each share, so cells and shares grow with the tables up
to what a task holds.  Only pivots and one row per cell pass through the driver; they are at most ``PIVOTS`` for
each length of vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Vectors that a cell is meant to hold at least, the bound on pivots, and vectors and queries of one group.
CELL, PIVOTS = 1024, 2048
BLOCK, SHARE = 1 << 15, 1 << 15
# Scores are compared at this many decimals, so that ranks do not depend on summation order.
DECIMALS = 9
# Allowance for the rounding of angles.
SLACK = 1e-7


def unit_vectors(df: DataFrame, id_col: str) -> DataFrame:
    """(<id_col>, d, zero, unit) of the rows of (<id_col>, vec) that have a vector: length, whether it is all
    zero, and the vector scaled to length one, as doubles."""
    kind = df.schema[id_col].dataType.simpleString()

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows, zero, starts = [], [], np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
                top = np.abs(flat[a:z]).max()
                x = flat[a:z] / top if top > 0 else flat[a:z]
                rows.append((x / np.linalg.norm(x) if top > 0 else x).tobytes())
                zero.append(not top > 0)
            yield pa.record_batch([b.column(0), pa.array(ends - starts, pa.int32()), pa.array(zero, pa.bool_()), pa.array(rows, pa.binary())], [id_col, "d", "zero", "unit"])

    whole = df.select(id_col, F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") > 0)
    return whole.where(~F.exists("vec", lambda v: v.isNull())).mapInArrow(scaled, f"{id_col} {kind}, d int, zero boolean, unit binary")


def _matrix(units, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, d)


def cell_size(n: int, cores: int) -> int:
    """Vectors of a cell, and queries of a share, so that ``n`` of each make some groups for every core."""
    return min(BLOCK, max(CELL, -(-n // math.isqrt(4 * cores))))


def choose_pivots(units: DataFrame, cell: int = CELL, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for each length: as many vectors, chosen by a hash of their values, as give cells of about
    ``cell`` vectors, at most ``most``."""
    places = Window.partitionBy("d").orderBy(F.xxhash64("unit"), "unit")
    sizes = units.groupBy("d").agg(F.count("*").alias("n"))
    # The least hashes of each length, kept as a share first so that no task sorts all vectors.
    share = units.join(sizes, "d").where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) * F.col("n") <= F.lit(4.0 * most * (1 << 20)))
    chosen = (
        share.select("d", "n", "unit").distinct().withColumn("r", F.row_number().over(places))
        .where((F.col("r") <= most) & (F.col("r") <= F.ceil(F.col("n") / cell))).select("d", "unit")
    )
    out: dict[int, list[bytes]] = {}
    for r in chosen.collect():
        out.setdefault(r.d, []).append(bytes(r.unit))
    return {d: _matrix(sorted(v), d) for d, v in out.items()}


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def assign_cells(units: DataFrame, id_col: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(<id_col>, d, cell, angle, unit): each vector with its nearest pivot; zero vectors are in cell -1, as are
    lengths without a pivot."""
    kind = units.schema[id_col].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, zero, units_ = (b.column(k) for k in (1, 2, 3))
            d, zero = d.to_numpy(), zero.to_numpy(zero_copy_only=False)
            cell, angle = np.full(len(d), -1, np.int32), np.zeros(len(d))
            for n in np.unique(d).tolist():
                at = np.flatnonzero((d == n) & ~zero)
                if n in pivots and len(at):
                    theta = _angles(_matrix(units_.take(pa.array(at)).to_pylist(), n), pivots[n])
                    cell[at] = theta.argmin(1)
                    angle[at] = theta.min(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell), pa.array(angle), units_], [id_col, "d", "cell", "angle", "unit"])

    return units.mapInArrow(near, f"{id_col} {kind}, d int, cell int, angle double, unit binary")


def _visits(queries: DataFrame, pivots: dict[int, np.ndarray], rings: dict[int, np.ndarray], nearest: bool) -> DataFrame:
    """(query_id, d, unit, cell): the cell with the best possible score of each query (``nearest``), or all others
    whose best possible score reaches the query's ``least``.  ``rings`` has (cell, low, high) rows for each length."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                d, zero, least = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
                lists: list[list[int]] = [[] for _ in range(len(d))]
                for n in np.unique(d).tolist():
                    if n not in rings:
                        continue
                    at = np.flatnonzero(d == n)
                    cells, low, high = rings[n].T
                    best = np.ones((len(at), len(cells)))
                    known = cells >= 0
                    if n in pivots and known.any():
                        theta = _angles(_matrix(b.column(3).take(pa.array(at)).to_pylist(), n), pivots[n][cells[known].astype(int)])
                        gap = np.maximum(np.maximum(theta - high[known], low[known] - theta) - SLACK, 0)
                        best[:, known] = np.cos(np.minimum(gap, np.pi))
                    best[zero[at]] = 1.0
                    first = best.argmax(1)
                    for r, q in enumerate(at.tolist()):
                        take = [first[r]] if nearest else [c for c in np.flatnonzero(best[r] + SLACK >= least[q]) if c != first[r]]
                        lists[q] = cells[take].astype(int).tolist()
                yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "d", "unit", "cells"])

    found = queries.select("query_id", "d", "zero", "unit", "least").mapInArrow(visiting, f"query_id {kind}, d int, unit binary, cells array<int>")
    return found.select("query_id", "d", "unit", F.explode("cells").alias("cell"))


def _k_best(sims: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores from the floor on, ties by column."""
    keep = sims >= floor
    if sims.shape[1] > k:
        keep &= sims >= np.partition(sims, -k, axis=1)[:, -k, None]
    rows, columns = np.nonzero(keep)
    order = np.lexsort((columns, -sims[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _met(floor: float, k: int):
    """Groups stand together, vectors before queries and in the order of their ids."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, units, matrix = None, [], [], None
        for b in batches:
            t = [b.column(c).to_numpy() for c in range(4)]
            side = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*t, side)], axis=0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(side)], strict=True):
                if a == z:
                    continue
                now, d = tuple(c[a] for c in t), int(t[0][a])
                if now != key:
                    key, ids, units, matrix = now, [], [], None
                part = b.slice(a, z - a)
                if not side[a]:
                    ids.append(part.column(5))
                    units += part.column(7).to_pylist()
                    matrix = None
                    continue
                if not units:
                    continue
                if matrix is None:
                    matrix, names = _matrix(units, d), pa.concat_arrays(ids)
                step = max(1, (1 << 21) // len(matrix))
                for i in range(0, z - a, step):
                    some = part.slice(i, step)
                    sims = np.round(_matrix(some.column(7).to_pylist(), d) @ matrix.T, DECIMALS)
                    rows, columns = _k_best(sims, floor, k)
                    yield pa.record_batch([some.column(6).take(pa.array(rows)), names.take(pa.array(columns)), pa.array(sims[rows, columns])], ["query_id", "record_id", "score"])

    return scored


def _meet(visits: DataFrame, cells: DataFrame, floor: float, k: int, share: int) -> DataFrame:
    """(query_id, record_id, score): the k best of every visited block for each visit."""
    types = visits.schema["query_id"].dataType.simpleString(), cells.schema["record_id"].dataType.simpleString()
    called = visits.groupBy("d", "cell").agg(F.ceil(F.count("*") / min(SHARE, share)).cast("int").alias("shares"))
    held = cells.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = cut_lineage(called.join(held, ["d", "cell"]))  # one row per cell
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda t: F.lit(None).cast(t)
    vectors = cells.join(sizes, ["d", "cell"]).select(
        "d", "cell", F.pmod(F.xxhash64("record_id", "unit"), F.col("blocks")).cast("int").alias("block"), each("shares").alias("share"),
        F.lit(False).alias("side"), "record_id", none(types[0]).alias("query_id"), "unit",
    )
    asking = visits.join(sizes, ["d", "cell"]).select(
        "d", "cell", each("blocks").alias("block"), F.pmod(F.xxhash64("query_id", "unit"), F.col("shares")).cast("int").alias("share"),
        F.lit(True).alias("side"), none(types[1]).alias("record_id"), "query_id", "unit",
    )
    key = ["d", "cell", "block", "share"]
    both = vectors.unionByName(asking).repartition(*key).sortWithinPartitions(*key, "side", "record_id")
    return both.mapInArrow(_met(floor, k), f"query_id {types[0]}, record_id {types[1]}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, floor: float, k: int, cell: int | None = None) -> DataFrame:
    """(query_id, rank, record_id, score): the k records with the greatest cosine, from ``floor`` on, ties by id.

    ``queries`` is (query_id, vec), ``vectors`` (record_id, vec).  Rows with a null or empty vector or null
    entries match nothing; vectors of different lengths neither; zero vectors have a cosine of 0.
    Repeated query ids share their results.  Empty tables give an empty result.  Cells hold about ``cell``
    vectors, by default as many as suit the tables.
    """
    probes, corpus = cut_lineage(unit_vectors(queries, "query_id")), unit_vectors(vectors, "record_id")
    if floor > 0:
        probes, corpus = probes.where(~F.col("zero")), corpus.where(~F.col("zero"))
    corpus = cut_lineage(corpus)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    cell = cell or cell_size(corpus.count(), cores)
    share = cell_size(probes.count(), cores)
    pivots = choose_pivots(corpus.where(~F.col("zero")), cell)
    cells = cut_lineage(assign_cells(corpus, "record_id", pivots))
    rings: dict[int, list] = {}
    for r in cells.groupBy("d", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("d", "cell").collect():
        rings.setdefault(r.d, []).append((r.cell, r.low, r.high))
    bounds = {d: np.array(rows, np.float64) for d, rows in rings.items()}
    first = cut_lineage(_meet(_visits(probes.withColumn("least", F.lit(float(floor))), pivots, bounds, True), cells, floor, k, share))
    # The k-th best score so far; a query with fewer hits has only the floor.
    reached = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    asking = probes.join(reached, "query_id", "left").withColumn("least", F.greatest(F.coalesce("kth", F.lit(float(floor))), F.lit(float(floor))))
    rest = _meet(cut_lineage(_visits(asking, pivots, bounds, False)), cells, floor, k, share)
    return _ranked(first.union(rest).distinct(), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "record_id", "score")
