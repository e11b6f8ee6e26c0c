from __future__ import annotations

import random

import corpus_pipeline as cp
from lorebook.llm import nearcopies
from lorebook.llm.simhash import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_copies_from_080_to_095_leave(spark, docs_of):
    """Planted copies stay if only fingerprints within two bits are linked; texts that share half stay."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, copies, apart = [], set(), 0
    for i in range(120):
        w = [word() for _ in range(150)]
        source, edited = " ".join(w), list(w)
        rows.append((i, source))
        while True:
            trial = list(edited)
            trial[rng.randrange(150)] = word()
            if jaccard(source, " ".join(trial)) < (0.8 if i % 2 else 0.88):
                break
            edited = trial
        text = " ".join(edited)
        assert 0.8 <= jaccard(source, text) <= 0.95
        apart += (simhash(source) ^ simhash(text)).bit_count() > 2
        copies.add(1000 + i)
        rows.append((1000 + i, text))
        rows.append((2000 + i, " ".join(w[:75] + [word() for _ in range(75)])))
    assert apart > 100
    left = [r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()]
    assert sorted(left) == sorted(i for i, _ in rows if i not in copies)


def test_groups_equal_brute_force(spark, docs_of):
    """A large group whose members differ from each other by more than from their source, in chains too."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(900)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base if i % 3 else rows[rng.randrange(len(rows))][1].split() if rows else base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(150):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8 or (simhash(rows[a][1]) ^ simhash(rows[b][1])).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted(i for i in range(150) if root(i) == i)
    assert 1 < len(want) < 150
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()) == want


def test_one_row_of_a_group_stays_with_null_and_repeated_ids(spark, docs_of):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (2, c), (2, c), (2, d), (3, d), (2, a), (None, ""), (4, None)]
    kept = cp.drop_near_copies(spark, docs_of(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, b), (1, a), (2, c), (2, d), (4, "")]
    assert len(kept) == 5


def test_large_family_of_an_unseen_source_makes_few_pairs(spark, docs_of, monkeypatch):
    """400 edited copies of a source that is no document: groups as by brute force, pairs not in the square."""
    rng = random.Random(12)
    word = lambda: f"u{rng.randrange(4000)}"
    base = [word() for _ in range(100)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(100)] = word() if rng.random() < 0.8 else "common"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) or (simhash(rows[a][1]) ^ simhash(rows[b][1])).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    made = []
    whole = nearcopies._pairs_beyond
    monkeypatch.setattr(nearcopies, "_pairs_beyond", lambda *a: made.append(whole(*a)) or made[-1])
    want = sorted(i for i in range(len(rows)) if root(i) == i)
    assert len(want) > 5
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()) == want
    assert made[0].count() < 20 * len(rows)


def test_own_columns_of_any_name_are_kept(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = "row _row fp sid bands root k lead at h a b x y n order share degree _fp _sid _bands key copies _k _copies _id size target".split()
    rows = [(1, text), (2, text), (3, "other words " + text[:40]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *[f"'{n}' as {n}" for n in names], "'s' as source")
    out = cp.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, text), (3, rows[2][1]), (0, kept[[r.doc_id for r in kept].index(None)].text or "")])
    assert all(r[n] == n for r in kept for n in names)
    mixed = cp.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and all(r[n] == n for r in mixed.collect() for n in names)
    rest = cp.drop_repeats(spark, df, "")
    assert rest.columns == df.columns and rest.count() >= 3
    empty = df.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for stage in (cp.drop_near_copies, cp.mix_sources, cp.drop_repeats))
