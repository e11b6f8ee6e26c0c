from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from lorebook.llm import prefixtrie
from lorebook.llm.prefixtrie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie by dictionaries: every node by its prefix, subtrees by walking all nodes."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((t is not None, t or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        full = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        child = [x for x in below if len(x) == len(node) + 1]
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(child),
            sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as c", "1 as k", "2 as depth", "'p' as path", "3 as p", "4 as n_convs", "array(1) as digest")
    df = prefix_trie(table)
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks and pieces of a few rows, so that carrying over them is tested too."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    monkeypatch.setattr(prefixtrie, "PIECE", 4)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 70), *range(-25, -15), 401, 402]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "a b", "c\td  e\n", None, "é ü"])))
    rows += [(None, 0, "user", "nobody's"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    assert got(spark, rows) == brute(rows)


def test_one_node_ends_most_conversations_and_long_conversations_share_a_part(spark):
    rows = [(c, 0, "user", "hello there") for c in range(0, 60)]
    # Two long ones with 6 turns in common, of 14 and 25; a third that is a copy of the first.
    for c, n in ((100, 14), (120, 25), (140, 14)):
        rows += [(c, t, "user", f"w{t if t < 6 or c != 120 else -t} x") for t in range(n)]
    want = brute(rows)
    assert max(r[3] for r in want) == 63
    assert got(spark, rows) == want


def test_turnless_single_and_empty(spark):
    # 5 has h = 3 turns to take from 0, which is absent: a conversation of one turn is left without any.
    assert zlib.crc32(b"5") % 4 > 0 or zlib.crc32(b"6") % 4 > 0
    for rows in ([(5, 0, "user", "a"), (6, 0, "user", "a"), (7, None, None, None)], [(40, 0, "user", "one two")], [(9, 1, "u", "x " * 50_000)]):
        assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "a")]) == []
