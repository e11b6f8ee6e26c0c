"""Scores by blocks against plain sums over all pairs."""

from __future__ import annotations

import random

import pytest

from lorebook.operators import retrieval as R
from lorebook.operators import scoring


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_blocks_equals_all_pairs(spark, monkeypatch, k):
    rng = random.Random(k)
    monkeypatch.setattr(scoring, "MOST_ENTRIES", 120)
    monkeypatch.setattr(scoring, "MOST_ROWS", 11)
    hits = [(f"r{r % 30:02d}" if r < 30 else f"r{r}", c, tf, 5 + r % 7) for r in range(34) for c, tf in {c: rng.randint(1, 3) for c in rng.choices(range(40), k=6)}.items()]
    # A phrase in every record, and records that are copies of each other.
    hits += [(f"r{r:02d}", 99, 1, 5 + r % 7) for r in range(34)] + [(f"z{i}", 7, 2, 6) for i in range(9)]
    weights = [(f"q{q}", c, rng.choice([0.5, 1.0, 2.5]), 6.0) for q in range(25) for c in {7, 99, *rng.choices(range(45), k=4)}]
    got = scoring.best_of_blocks(
        spark.createDataFrame(hits, "record_id string, code bigint, tf bigint, dl bigint"),
        spark.createDataFrame(weights, "query_id string, code bigint, weight double, avgdl double"), R._part, k, 0.0, 9,
    )
    got = {(r.query_id, r.rank): (r.record_id, round(r.score, 9)) for r in R.top_ranked(R._rounded(got), k).collect()}
    want = {}
    for q in {w[0] for w in weights}:
        scores: dict[str, float] = {}
        for _, code, w, avgdl in (x for x in weights if x[0] == q):
            for record, c, tf, dl in hits:
                if c == code:
                    scores[record] = scores.get(record, 0.0) + w * R._part(float(tf), float(dl), avgdl)
        best = sorted((-round(s, 9), record) for record, s in scores.items())[:k]
        want |= {(q, i + 1): (record, -s) for i, (s, record) in enumerate(best)}
    assert got == want


def test_topk_shuffles_no_pairs(spark, capsys):
    """The queries meet the records inside tasks: no join of hits and weights is left in the plan."""
    docs = spark.createDataFrame([(f"r{i}", f"alpha beta w{i % 5}") for i in range(20)], "record_id string, body string")
    queries = spark.createDataFrame([("q", "alpha w1"), ("p", "beta w2 w3")], "query_id string, text string")
    R.bm25_topk(queries, R.token_index(docs, ["body"]), 3).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("exact", [1 << 53, 1])
def test_lexical_match_equals_all_pairs(spark, monkeypatch, capsys, exact):
    monkeypatch.setattr(R, "EXACT", exact)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "a-b", *(f"w{i}" for i in range(9))], k=n))
    docs, asked = [(f"r{i:02d}", text(rng.randint(0, 30))) for i in range(40)], [(f"q{i}", text(rng.randint(0, 12))) for i in range(9)]
    tokens = R.token_index(spark.createDataFrame(docs, "record_id string, body string"), ["body"])
    queries = spark.createDataFrame(asked, "query_id string, text string")
    out = R.lexical_match(queries, tokens, 4)
    want = set()
    hits = {(r.phrase, r.record_id): r.tf for r in R.phrase_hits(tokens, R.query_phrases(queries)).collect()}
    wanted = R.query_phrases(queries).collect()
    for q, _ in asked:
        found: dict[str, list[int]] = {}
        for w in wanted:
            for (phrase, record), tf in hits.items():
                if w.query_id == q and w.phrase == phrase:
                    one = found.setdefault(record, [0, 0])
                    one[0] += 1
                    one[1] += w.qtf * tf
        want |= {(q, n, r, m, tf) for n, (m, tf, r) in enumerate(sorted(((m, tf, r) for r, (m, tf) in found.items()), key=lambda x: (-x[0], -x[1], x[2]))[:4], 1)}
    assert {tuple(r) for r in out.collect()} == want
    out.explain()
    # Pairs of queries and records are not shuffled.
    assert ("FlatMapCoGroupsInArrow" in capsys.readouterr().out) == (exact > 1)


def test_document_tokens_count_without_another_shuffle(spark, sf, capsys):
    """Records lie by their id, so a phrase is counted where its record is."""
    from lorebook.plans import tables as T

    phrases = spark.createDataFrame([("q", "the"), ("q", "of")], "query_id string, phrase string")
    R.phrase_hits(T.document_tokens(spark, sf), phrases).explain()
    assert "hashpartitioning(phrase" not in (plan := capsys.readouterr().out) and "hashpartitioning(record_id" in plan


def test_entries_of_a_record_are_put_together_where_they_are_counted(spark, sf, monkeypatch):
    """The one shuffle deals the records; none of their hits, which would grow a task with the table."""
    from lorebook.plans import tables as T

    plans, store = [], scoring.cut_lineage
    monkeypatch.setattr(scoring, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    for ranked in (R.bm25_topk, R.lexical_match):
        plans.clear()
        assert ranked(T.benchmark_queries(spark, sf), T.document_tokens(spark, sf), 3).count()
        (plan,) = [p for p in plans if "ObjectHashAggregate(keys=[record_id" in p]
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") >= 1
