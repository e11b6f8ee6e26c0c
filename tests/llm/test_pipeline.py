from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from lorebook.llm import simhash
from lorebook.llm.bpe import VOCABULARY, codec
from test_simhash import brute as near_groups
from test_substring import brute as repeats

import public_tokenizers


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic and clean documents with near copies and shared passages; every other one labelled."""
    rng = random.Random(11)
    parts = ["the", "of", "tion", "er", "ing", "ound", "st", "al", "re", "en", "ly", "ment"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(70)) for _ in range(3)]
    rows = []
    for i in range(400):
        w = [word() for _ in range(rng.randint(60, 160))]
        if i % 5 == 0:
            for _ in range(8):
                w.insert(rng.randrange(len(w)), rng.choice(["wretchfool", "grubhead", "quarkface"]))
        rows.append([i, " ".join(w), "en", f"s{i % 4}" if i % 9 else None])
    for i in range(400, 430):
        rows.append([i, rows[i - 390][1], "en", "s1"])
    for i in range(430, 460):
        rows.append([i, f"{' '.join(word() for _ in range(60))} {passages[i % 3]}", "fr", "s2"])
    rows += [[460, None, None, None], [461, "", "en", "s0"], [462, " \n", "en", "s0"]]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return rows, str(d)


def test_stages_against_brute_force(spark, corpus):
    rows, d = corpus
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given = {r[0]: r[1] for r in rows}
    for name, stage in cp.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = cp.stored(stage(spark, docs, d))
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        ids = Counter(i for i, _ in after)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
        if name == "toxicity":
            toxic = {i for i, t in given.items() if t and "wretchfool" in t or t and "grubhead" in t or t and "quarkface" in t}
            assert set(ids) == set(given) - toxic and all(given[i] == t for i, t in after)
        elif name == "simhash and shingle near-dedup":
            assert sorted(ids) == sorted(i for i, c in near_groups(before).items() if i == c) and max(ids.values()) == 1
        elif name == "substring dedup":
            want = {i: k for i, n, gone, k in repeats(before, 50) if not n or gone < n}
            assert set(ids) == set(want) and {i: hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() for i, t in after} == want
            assert any(len(t or "") < len(given[i] or "") for i, t in after)
        else:
            words = {i: len((t or "").split()) for i, t in before}
            total = sum(words.values())
            assert set(ids) <= set(words) and max(ids.values()) <= 2
            assert abs(sum(words[i] * c for i, c in ids.items()) - 1.5 * total) < 0.02 * total
    mixed = docs.collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.STAGES[-1][1](spark, docs, d).collect())
    code = codec(public_tokenizers.path(VOCABULARY))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r.doc_id: code.encode(r.text or "") for r in mixed}
    assert got == Counter((r.doc_id, len(ids[r.doc_id]) // 4, sha(ids[r.doc_id]), sha((r.text or "").encode())) for r in mixed)


def test_run_is_repeatable_and_takes_an_empty_table(spark, corpus, tmp_path):
    _, d = corpus
    a, b = (sorted(map(tuple, cp.run(spark, d).collect())) for _ in range(2))
    assert a == b and len(a) > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert simhash.RADIUS == 2
