"""The stored index: equal to look-ups in plain tokens, in one segment, several, and merged ones."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from lorebook.operators import inverted
from lorebook.operators import retrieval as R
from lorebook.operators.inverted import StoredIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 25
    word = lambda: rng.choice(vocabulary)
    rows = [(f"r{i:03d}", " ".join(word() for _ in range(rng.randint(0, 60))), " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(150)]
    rows += [("empty", "", ""), ("twin1", rows[3][1], rows[3][2]), ("twin2", rows[3][1], rows[3][2]), ("long", "the w1-w2 " * 3000, "w1")]
    return rows


def tokens_of(spark, rows):
    return R.token_index(spark.createDataFrame(rows, "record_id string, body string, title string"), ["title", "body"])


@pytest.fixture(scope="module")
def queries(spark, texts):
    rng = random.Random(4)
    rows = [(f"q{i}", " ".join(f"w{rng.randrange(70)}" for _ in range(rng.randint(1, 6)))) for i in range(25)]
    rows += [("phrase", "w1-w2 the.w3"), ("all", texts[3][1]), ("none", "unseen words"), ("blank", ""), ("stop", "the the the")]
    return spark.createDataFrame(rows, "query_id string, text string")


def same(index, plain, queries, served):
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = R.query_phrases(queries)
    assert rows(R.phrase_hits(index, wanted, ["dl"])) == rows(R.phrase_hits(plain, wanted, ["dl"]))
    assert rows(R.doc_freq(index, wanted, served)) == rows(R.doc_freq(plain, wanted, served))
    for k, floor, some in ((3, None, None), (200, 0.0, served)):
        assert rows(R.bm25_topk(queries, index, k, floor, some)) == rows(R.bm25_topk(queries, plain, k, floor, some))


def test_small_blocks_equal_plain_tokens(spark, texts, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "LEAST_TOKENS", 400)
    monkeypatch.setattr(inverted, "MOST_TOKENS", 400)
    monkeypatch.setattr(inverted, "PASS", 12)
    plain = tokens_of(spark, texts)
    index = StoredIndex.build(plain, f"{tmp_path}/i")
    assert index.term_rows().select("block").distinct().count() > 8
    served = plain.where("record_id < 'r070' OR record_id LIKE 'twin%'").select("record_id")
    same(index, plain, queries, served)
    rows = lambda df: sorted(map(tuple, df.collect()))
    wanted = R.query_phrases(queries)
    assert rows(R.phrase_hits(index, wanted, among=served)) == rows(R.phrase_hits(plain, wanted, among=served))
    assert rows(R.lexical_match(queries, index)) == rows(R.lexical_match(queries, plain))
    # Another reader opens the same index from its folder.
    again = StoredIndex.open(spark, f"{tmp_path}/i")
    assert again == index and again.totals() == (len(texts), plain.agg(F.avg("dl")).first()[0])
    assert StoredIndex.open(spark, f"{tmp_path}/absent") is None


def test_added_and_merged_segments_equal_a_rebuild(spark, texts, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "LEAST_TOKENS", 1500)
    old = StoredIndex.build(tokens_of(spark, texts[:100]), f"{tmp_path}/i")
    # The second segment brings records and replaces two; one of these loses all its words.
    changed = [("r005", "w1 w2 w3 w4", "the"), ("r006", "", "")]
    new = old.add(tokens_of(spark, texts[100:] + changed))
    now = [r for r in texts if r[0] not in ("r005", "r006")] + changed
    plain = tokens_of(spark, now)
    assert len(new.segments) == 2
    same(new, plain, queries, plain.where("record_id < 'r110'").select("record_id"))
    merged = new.merge(factor=100)
    assert len(merged.segments) == 1 and StoredIndex.open(spark, f"{tmp_path}/i") == merged
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.phrase_hits(merged, R.query_phrases(queries), ["dl"])) == rows(R.phrase_hits(plain, R.query_phrases(queries), ["dl"]))
    # A reader that opened the old version still sees it whole.
    assert old.totals()[0] == 100
    assert old.merge() is old


def test_corpus_side_is_not_shuffled(spark, texts, queries, tmp_path):
    """Between the scan of the blocks and the step that reads them with their visits there is no exchange."""
    index = StoredIndex.build(tokens_of(spark, texts), f"{tmp_path}/i")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = index.hits(R.query_phrases(queries))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    place = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "_blocks[" in line)
    above, depth = [], place(lines[at])
    for line in reversed(lines[:at]):
        if place(line) < depth:
            above.append(line)
            depth = place(line)
    above = above[: next(i for i, line in enumerate(above) if "FlatMapCoGroups" in line)]
    assert above and not any("Exchange" in line for line in above), above


def test_empty_index(spark, queries, tmp_path):
    plain = tokens_of(spark, [])
    index = StoredIndex.build(plain, f"{tmp_path}/i")
    assert R.bm25_topk(queries, index, 3).count() == 0 and index.hits(R.query_phrases(queries)).count() == 0


def test_memory_of_a_full_block():
    """Building and opening a block of the greatest size takes a bounded share of an executor's Python."""
    each = 512
    records = inverted.MOST_TOKENS // each
    terms = pa.array([f"t{i % 50_000}" for i in range(records * each)])
    columns = pa.ListArray.from_arrays(pa.array(range(0, records * each + 1, each), pa.int32()), terms)
    fields = pa.ListArray.from_arrays(pa.array(range(records + 1), pa.int32()), columns)
    block = pa.table({"block": [0] * records, "record_id": [f"r{i:06d}" for i in range(records)], "fields": fields, "dl": [each] * records})
    tracemalloc.start()
    opened = inverted._Block(inverted._block_rows((pa.scalar(0),), block), float(each))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(opened.ids) == records and peak < 256 << 20
