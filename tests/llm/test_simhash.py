from __future__ import annotations

import random

import numpy as np
import xxhash
from lorebook.llm.simhash import BKTree, local_links, simhash, simhash_groups


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    """component of every id (ids unique, not null)"""
    fp = {i: fingerprint(t) for i, t in rows}
    comp = {i: i for i in fp}
    ids = sorted(fp)
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min(comp[j] for j in ids if (fp[i] ^ fp[j]).bit_count() <= 2)
            if m < comp[i]:
                comp[i], changed = m, True
    return comp


def test_groups_and_fingerprints(spark, docs_of):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts = list(base)
    for _ in range(140):
        w = rng.choice(texts).split()
        if w:
            w[rng.randrange(len(w))] = rng.choice(["ONE", "two"])
        texts.append(" ".join(w))
    texts += [None, "", "\t\n", "A", "a", "É ß", "x " * 200_000]
    rows = list(enumerate(texts, 3))
    want = brute(rows)
    got = simhash_groups(docs_of(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{fingerprint(dict(rows)[r.doc_id]):016x}" for r in got)
    assert len(set(want.values())) < len(want) - 20
    assert simhash_groups(docs_of(rows).limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark, docs_of):
    got = simhash_groups(docs_of([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s t u")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    values = {int(v) for v in rng.integers(0, 1 << 12, 600)}
    tree = BKTree()
    for v in sorted(values):
        tree.add(v)
    for q in range(0, 1 << 12, 37):
        assert sorted(tree.values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    chain = [0, 0b11, 0b1111, 0b111111, 0x7F << 40]
    assert {a: b for a, b in local_links(chain)} == {0b11: 0, 0b1111: 0, 0b111111: 0}
    assert simhash("a b c") == simhash("A B  C\n") != simhash("a b d")
