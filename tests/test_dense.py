"""Exact cosine search over pivot cells, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from lorebook.operators import dense


def brute(queries, vectors, floor, k):
    out = set()
    for qid, q in queries:
        found = []
        for rid, v in vectors:
            if q and v and len(q) == len(v) and None not in v and None not in q:
                a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                score = round(float(a @ b / norm), 9) if norm > 0 else 0.0
                if score >= floor:
                    found.append((-score, rid))
        out |= {(qid, n, rid, round(-s, 6)) for n, (s, rid) in enumerate(sorted(found)[:k], 1)}
    return out


def table(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} string, vec array<float>").selectExpr("*", "1 as d", "2 as cell", "'x' as unit", "3 as least")


@pytest.fixture(scope="module")
def clustered():
    """Close groups, a hot vector, zero vectors, another length, and rows without a usable vector."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 3
    x = [(c + rng.standard_normal(16) * s).tolist() for c in centres for s in [0.05] * 10 + [1.0] * 10]
    rows = [(f"r{i:03d}", v) for i, v in enumerate(x)] + [(f"h{i:03d}", x[5]) for i in range(120)]
    rows += [("z0", [0.0] * 16), ("z1", [0.0] * 16), ("s0", [1.0, 2.0]), ("s1", [2.0, 1.0]), ("e", []), ("n", None), ("m", [None] * 16)]
    return rows


@pytest.mark.parametrize("floor, cell", [(0.2, 20), (0.95, 5), (-1.0, 40)])
def test_equals_all_pairs(spark, clustered, floor, cell):
    queries = clustered[::9] + clustered[-7:]
    got = dense.nearest(table(spark, "query_id", queries), table(spark, "record_id", clustered).repartition(4), floor, 5, cell).collect()
    assert {(r.query_id, r["rank"], r.record_id, round(r.score, 6)) for r in got} == brute(queries, clustered, floor, 5)


def test_bounds_rule_out_cells(spark, clustered):
    """With the k-th best score known, a query of a close group visits few of the other cells."""
    rows = [r for r in clustered if r[0][0] == "r"]
    units = dense.unit_vectors(table(spark, "record_id", rows), "record_id")
    pivots = dense.choose_pivots(units, 10)
    cells = dense.assign_cells(units, "record_id", pivots).collect()
    n = len(pivots[16])
    assert n == 24
    bounds = {16: np.array([(c, min(a), max(a)) for c in range(n) if (a := [r.angle for r in cells if r.cell == c])])}
    asking = dense.unit_vectors(table(spark, "query_id", rows[:10]), "query_id").selectExpr("*", "0.99D as least")
    assert dense._visits(asking, pivots, bounds, False).count() < 10 * len(bounds[16]) / 3


def test_blocks_and_shares_of_a_hot_cell(spark, clustered, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 16)
    monkeypatch.setattr(dense, "SHARE", 8)
    queries = clustered[::5]
    got = dense.nearest(table(spark, "query_id", queries), table(spark, "record_id", clustered), 0.5, 3, 400).collect()
    assert {(r.query_id, r["rank"], r.record_id, round(r.score, 6)) for r in got} == brute(queries, clustered, 0.5, 3)


def test_cells_grow_with_the_table(spark, clustered):
    """A query is shuffled at most once for each cell, so cells are as large as a task may hold."""
    assert dense.cell_size(2_000, 8) == dense.CELL and 5_000 < dense.cell_size(50_000, 8) < dense.BLOCK
    assert dense.cell_size(600_000, 12) == dense.BLOCK >= 1 << 15
    got = dense.nearest(table(spark, "query_id", clustered[::5]), table(spark, "record_id", clustered), 0.5, 3).collect()
    assert {(r.query_id, r["rank"], r.record_id, round(r.score, 6)) for r in got} == brute(clustered[::5], clustered, 0.5, 3)


def test_empty_tables(spark):
    one, none = [("a", [1.0, 0.0])], []
    for q, v in ((one, none), (none, one), (none, none)):
        assert dense.nearest(table(spark, "query_id", q), table(spark, "record_id", v), 0.1, 3).count() == 0
