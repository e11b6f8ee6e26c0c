from __future__ import annotations

import math

import numpy as np
import pytest
from lorebook.llm import rabitq
from lorebook.llm.rabitq import bands_for, encode, judge, near_vectors


def brute(rows):
    ok = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links = {id(r): 0 for r in rows}
    parent = {id(r): id(r) for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a in enumerate(ok):
        for b in ok[:k]:
            if len(a[1]) != len(b[1]):
                continue
            x, y = np.float64(np.float32(a[1])), np.float64(np.float32(b[1]))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[id(a)] += 1
                links[id(b)] += 1
                parent[root(id(a))] = root(id(b))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[root(id(r))] = min(r[0], least.get(root(id(r)), r[0]))
    key = lambda t: str(t)
    return sorted([(r[0], links[id(r)], least.get(root(id(r))), r[0] == least.get(root(id(r)))) for r in rows], key=key)


@pytest.mark.parametrize("block", [1_000, 40])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 48))
    x = [rng.standard_normal(48) for _ in range(150)]
    # Groups whose members lie on either side of the limit.
    x += [centres[k % 30] + rng.standard_normal(48) * s for k, s in enumerate(np.tile([0.05, 0.2, 0.3, 0.34, 0.4], 60))]
    x += [centres[0] + rng.standard_normal(48) * 0.02 for _ in range(150)]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(900 + i, rows[3][1]) for i in range(60)] + [(990, None), (991, []), (992, [0.0] * 48), (993, [math.nan] + [1.0] * 47), (994, [math.inf] + [1.0] * 47)]
    rows += [(995, [1.0, None]), (996, [1e-30, 0.0]), (997, [1e30, 1e28]), (None, rows[5][1]), (998, [3.0]), (5, rows[5][1]), (999, [v * 7 for v in rows[9][1]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as cid", "2 as weight", "'k' as key")
    got = sorted([tuple(r) for r in near_vectors(df).collect()], key=str)
    want = brute(rows)
    pairs = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.97 * pairs and sum(g[1] for g in got) <= pairs
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)
    assert near_vectors(df.limit(0)).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + rng.standard_normal((200, 64)) * rng.uniform(0.1, 0.7, (200, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rounded, unit, factor, error = encode(x)
    i, j = np.arange(200), np.arange(200, 400)
    cosine = (x[i] * x[j]).sum(1)
    sure, undecided = judge(rounded, unit, factor, error, (i, j))
    assert (cosine[sure] >= 0.9).all() and (sure | undecided)[cosine >= 0.9].all() and undecided.mean() < 0.2
    code = np.where(rounded >= 0, 1, -1) / 8
    assert abs(((code[i] * (rounded[j] * unit[j][:, None])).sum(1) / factor[i] - cosine).mean()) < 0.02


def test_band_count_follows_the_input():
    assert bands_for(1_000)[0] < bands_for(10**9)[0]
    for n in (10, 10**5, 10**9):
        bits, bands = bands_for(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** bands >= 0.99
