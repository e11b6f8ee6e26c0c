"""Phrases as numbers, and scores by blocks that read the stored records, against plain counts over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorebook.functions import text as X
from lorebook.operators import gate as G
from lorebook.operators import retrieval as R
from lorebook.operators import scoring

WORDS = ["alpha", "beta", "a-b", "A.b", "x-y-z", "(beta)", "--", "½", "b", "y", *(f"w{i}" for i in range(9))]


def _texts(rng, n, longest):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, longest))) for _ in range(n)]


def _tables(spark, rng):
    """Records of two columns, some of them twice or without an id, and queries of the same kind."""
    ids = [None if i % 17 == 3 else f"r{i % 30:02d}" for i in range(40)]
    docs = list(zip(ids, _texts(rng, 40, 25), _texts(rng, 40, 12), strict=True))
    asked = [(None if i == 4 else f"q{i % 9}", t) for i, t in enumerate([*_texts(rng, 12, 14), None])]
    tokens = R.token_index(spark.createDataFrame(docs, "record_id string, title string, body string"), ["title", "body"])
    return tokens, spark.createDataFrame(asked, "query_id string, text string")


@pytest.mark.parametrize("served", [False, True])
@pytest.mark.parametrize("max_tokens", [None, 5])
def test_topk_equals_plain_scores(spark, served, max_tokens):
    tokens, queries = _tables(spark, random.Random(7))
    among = spark.createDataFrame([(f"r{i:02d}",) for i in range(0, 30, 2)] * 2, "record_id string") if served else None
    rows = lambda df: {(r.query_id, r.rank, r.record_id, round(r.score, 6)) for r in df.collect()}
    plain = R.bm25_scores(queries, tokens, among, max_tokens)
    for floor in (-1.0, 0.3):
        want = rows(R.top_ranked(R.apply_floor(plain, floor), 4))
        assert want and rows(R.bm25_topk(queries, tokens, 4, floor, among, max_tokens)) == want


def test_phrases_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    words = ["alpha", "beta", *(f"w{i}" for i in range(9))]
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(words, k=20))
    tokens = R.token_index(spark.createDataFrame([(f"r{i}", text()) for i in range(12)], "record_id string, body string"), ["body"])
    queries = spark.createDataFrame([(f"q{i}", text()) for i in range(5)], "query_id string, text string")
    salts, make = [], scoring.query_entries
    monkeypatch.setattr(scoring, "query_entries", lambda p, salt, bits: salts.append(salt) or make(p, salt, bits))
    same = [len({*scoring._number(scoring._hashed([w.encode() for w in words], salt)[:, 0], 6).tolist()}) < len(words) for salt in range(9)]
    asked, records, df, n, average = scoring.matched(queries.select("query_id", X.seamed_phrases("text").alias("phrases")), tokens, bits=6)
    assert salts == list(range(same.index(False) + 1)) and len(salts) > 1
    assert n == 12 and average == 20
    hits = R.phrase_hits(tokens, R.query_phrases(queries)).collect()
    assert Counter(r.tf for r in scoring.entries(records).join(df, "code").collect()) == Counter(r.tf for r in hits)
    assert Counter(r.df for r in df.collect()) == Counter(Counter(r.phrase for r in hits).values())
    assert sorted(r.qtf for r in R.query_phrases(queries).collect()) == sorted(q for r in asked.collect() for q in r.qtfs)


def test_seamed_phrases_are_the_terms_of_tokens(spark):
    texts = ["½ ½a .½. a½.b İstanbul ΣΑΣ, Ⅷ Ⅷx foo\x01bar a b x　y --- -a- a--b--c ét", "", "\x01", "\x85d e ٣,x", None, "..½ ½½"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = df.select(X.seamed_phrases("text").alias("a"), F.transform(X.query_tokens("text"), R.as_phrase).alias("b"))
    for r in out.collect():
        assert (r.a is None) == (r.b is None)
        assert [w for w in (x.strip("\x01").replace("\x01", " ") for x in r.a or []) if w] == [w for w in r.b or [] if w]


def test_nothing_is_copied_for_each_pair_of_blocks(spark, monkeypatch, capsys):
    """Queries are dealt to their block once, and records are read where they lie: before, both were copied."""
    monkeypatch.setattr(scoring, "MOST_ENTRIES", 60)
    tokens, queries = _tables(spark, random.Random(5))
    out = R.bm25_topk(queries, tokens, 3)
    assert out.count()
    out.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_corroborate_makes_its_tokens_once(spark):
    """What tells the tokens may read the whole corpus (a stop list): no later step goes back to it."""
    tokens, queries = _tables(spark, random.Random(5))
    index = R.CorpusIndex(None, None, None, tokens)
    asked = queries.select("query_id", F.explode(X.query_tokens("text")).alias("token")).distinct().where("query_id is not null")
    asked = asked.mapInArrow(lambda batches: batches, "query_id string, token string").withColumn("phrase", R.as_phrase(F.col("token"))).where("phrase <> ''")
    hits = R.bm25_topk(queries, tokens, 3, -1.0)
    out = G.corroborate(hits, asked, index)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    held = {(r.phrase, r.record_id) for r in R.phrase_hits(tokens, R.query_phrases(queries)).collect()}
    mine = asked.collect()
    want = {
        (h.query_id, h.record_id) for h in hits.collect()
        if len({a.token for a in mine if a.query_id == h.query_id and (a.phrase, h.record_id) in held}) >= 2 and h.query_id and h.record_id
    }
    assert want and {(r.query_id, r.record_id) for r in out.collect()} == want
