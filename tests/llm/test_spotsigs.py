from __future__ import annotations

import hashlib
import random
import re

from lorebook.llm.spotsigs import ANCHORS, edited_fingerprints, similar_fingerprints


def signatures(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in ANCHORS:
            chain = [y for y in w[i + 1 :] if y not in ANCHORS][:3]
            if len(chain) == 3:
                out.add((x, *chain))
    return out or ({("whole", " ".join(w) or text)} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sample(rng, n):
    v = [*ANCHORS[:30], *[f"w{k}" for k in range(60)], "Über", "x" * 300]
    sep = [" ", ", ", "\n", "!"]
    return ["".join(rng.choice(v) + rng.choice(sep) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_against_sets(spark, docs_of):
    rng = random.Random(8)
    texts = sample(rng, 120)
    ids = rng.sample(range(1000), 120)
    rows = list(zip(ids, texts, strict=True)) + [(2001, None), (2002, ""), (2003, texts[0]), (2004, texts[0]), (2005, "the"), (2006, "!?"), (2007, "the of 😀 " * 3000)]
    got = {r.doc_id: r for r in edited_fingerprints(docs_of(rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(signatures(t), signatures(edited))) < 1e-9
        assert abs(r.near_next - jaccard(signatures(t), signatures(nxt))) < 1e-9
        assert len(r.fingerprint) == 16 * len(signatures(t)) and len(r.edited_fingerprint) == 16 * len(signatures(edited))
    assert got[2003].fingerprint == got[2004].fingerprint == got[order[[x for x, _ in order].index(ids[0])][0]].fingerprint
    assert got[2001].fingerprint == "" == got[2002].fingerprint


def test_ties_nulls_and_repeated_rows(spark, docs_of):
    rows = [(None, "a b"), (None, "c d"), (1, "the x y z"), (1, "the x y z"), (1, "other"), (2, None)]
    df = docs_of(rows)
    assert edited_fingerprints(df).count() == 6 and edited_fingerprints(df.limit(0)).count() == 0
    one = edited_fingerprints(docs_of([(7, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_similar_sets_are_all_found(spark, docs_of):
    rng = random.Random(9)
    texts = [t + " the a1 b1 c1 d1 of e1 f1 g1 h1" for t in sample(rng, 60)]
    for t in texts[:40]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(signatures(t)), i)
    items = list(sets.items())
    want = {(min(i, j), max(i, j)) for a, i in items for b, j in items if i < j and jaccard(a, b) >= 0.8}
    got = {(r.a, r.b) for r in similar_fingerprints(docs_of(list(enumerate(texts)))).collect()}
    assert got == want and want
