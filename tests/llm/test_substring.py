from __future__ import annotations

import hashlib
import random

import numpy as np
from lorebook.llm.substring import Rolling, drop_repeats, repeated_passages, winnow


def brute(rows, window):
    starts = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            if i is not None:
                starts.setdefault(tuple(w[p : p + window]), set()).add(i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and min(starts[tuple(w[p : p + window])]) < i:
                gone |= set(range(p, p + window))
        kept = b" ".join(w[k] for k in range(len(w)) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_against_every_window(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = "edit"
        rows.append((i * 3 % 161, " ".join(text)))
    rows += [(500, rows[0][1]), (501, rows[0][1].replace(" ", "\t\n")), (502, None), (503, ""), (504, "a " * 300), (505, "a " * 200), (None, rows[1][1]), (506, rows[1][1]), (506, rows[1][1]), (506, "b " * 90)]
    got = repeated_passages(docs_of(rows), window=20, k=6).drop("tk").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 20), key=key)


def test_a_passage_in_a_third_of_the_documents(spark, docs_of):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(rng.randint(5, 40)))
    rows = [(i, f"{own(i)} {passage} {own(-i)}" if i % 3 == 0 else own(i)) for i in range(300)]
    got = {r.doc_id: r for r in repeated_passages(docs_of(rows)).collect()}
    assert [got[i].n_removed for i in range(300)] == [70 if i % 3 == 0 and i else 0 for i in range(300)]


def test_texts_without_the_passages(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    df = docs_of([(1, f"one {passage}"), (2, f"two\n {passage} end"), (3, passage), (4, "short"), (5, None)])
    got = {r.doc_id: r for r in drop_repeats(df).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "two end" and got[2].n_chars == 7
    assert got[1].text == f"one {passage}" and got[5].text is None and drop_repeats(df).columns == df.columns
    assert repeated_passages(df.limit(0)).count() == 0


def test_every_run_holds_an_anchor_and_runs_hash_alike():
    h = np.array([5, 3, 3, 9, 1, 7, 7, 7, 2], np.uint64)
    chosen = set(winnow(h, 3).tolist())
    assert all(chosen & {i, i + 1, i + 2} for i in range(7))
    r = Rolling(b"a b c a b c x".split())
    x = r.runs(np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert x[0] == x[1] != x[2]
