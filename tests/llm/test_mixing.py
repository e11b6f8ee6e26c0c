from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from lorebook.llm.mixing import pareto_mix, repeat_by_copies, source_targets


def targets(size):
    """Sources share 150 % of all words by weight; what goes beyond twice a source is reshared."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            return share | {s: 2.0 * size[s] for s in full}
        full |= over


def rows_of(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["Z", "a", "é", None, "b", "c"])
        rows.append((i, rng.choice([" ", "\n", " "]).join("w" for _ in range(rng.randint(0, 200))), source))
    return rows


def test_targets_and_words_taken(spark, docs_of):
    rng = random.Random(1)
    rows = [*rows_of(rng, 3000), (9000, None, "a"), (9001, "", "empty"), (9002, None, "empty")]
    got = pareto_mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    size, taken = defaultdict(int), defaultdict(int)
    for i, _, s in rows:
        size[s] += words[i]
    want = targets(size)
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 200
    assert sorted(got) == sorted(pareto_mix(docs_of(rows).repartition(7)).collect())


def test_the_source_at_its_limit_is_taken_twice(spark, docs_of):
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(100 + i, "w " * 50, "b") for i in range(100)]
    got = pareto_mix(docs_of(rows)).collect()
    assert all(r.copies == 2 for r in got if r.doc_id < 100)


def test_longer_documents_are_likelier(spark, docs_of):
    rows = [(i, "w " * (20 if i % 2 else 200), "b") for i in range(4000)] + [(9999, "w", "a")]
    copies = {r.doc_id: r.copies for r in pareto_mix(docs_of(rows)).collect()}
    assert sum(copies[i] for i in range(0, 4000, 2)) > 1.2 * sum(copies[i] for i in range(1, 4000, 2))


def test_null_ids_ties_and_empty_tables(spark, docs_of):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (3, "a b", None), (3, "a b", None), (4, None, None)]
    df = docs_of(rows)
    mix = pareto_mix(df)
    assert mix.count() == 5
    repeated = repeat_by_copies(df, mix)
    assert repeated.columns == df.columns
    assert pareto_mix(df.limit(0)).count() == 0 and pareto_mix(docs_of([(1, None, "a"), (2, "", None)])).count() == 2
    assert source_targets(df.limit(0).selectExpr("doc_id", "source", "1L as size")).count() == 0
