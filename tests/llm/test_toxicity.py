from __future__ import annotations

import random
import zlib

import pytest
from lorebook.llm.toxicity import Model, drop_toxic, fit, score_toxicity, train, widen


def sample(rng, n):
    parts = ["the", "of", "tion", "er", "ing", "ound", "st", "al", "re", "en"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 25):
                w.insert(rng.randrange(len(w)), rng.choice(["wretchfool", "Grubhead,", "quarkface"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = sample(random.Random(1), 700)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], None, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None), (10**6, 1, 1)], "doc_id bigint, quality int, toxic int")
    return rows, docs, train(docs, labels)


def test_accuracy_on_documents_held_out(spark, fitted):
    rows, docs, model = fitted
    truth = {r[0]: r[2] for r in rows}
    got = score_toxicity(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_odd_texts_and_kept_rows(spark, docs_of, fitted):
    model = fitted[2]
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é😀 " * 50_000), (4, "a wretchfool and a quarkface, you grubhead wretchfool")]
    got = {(r.doc_id, r.score) for r in score_toxicity(docs_of(rows), model).collect()}
    assert len({i for i, _ in got}) == 5 and all(s < 0.5 for i, s in got if i in (1, 2, 3))
    kept = drop_toxic(docs_of(rows), model)
    assert kept.columns == docs_of(rows).columns and sorted(str(r.doc_id) for r in kept.collect() if r.doc_id != 4) == ["1", "2", "3", "3", "None"]
    assert score_toxicity(docs_of(rows).limit(0), model).count() == 0


def test_without_both_classes_scores_are_zero(spark, docs_of):
    assert fit([("a b", 0)]).weights == [] and Model().score("x") == 0.0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in score_toxicity(docs_of([(1, "x")]), train(docs_of([(1, "x")]), none)).collect()] == [0.0]
    tiny = fit([("good words here", 0), ("bad wretch here", 1)])
    assert 0 <= tiny.score("anything") <= 1
    assert len(widen("")) == 0 and len(widen("ab")) == 1
