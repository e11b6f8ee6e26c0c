from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from lorebook.llm.bpe import VOCABULARY, RankQueue, bpe_round_trip, codec, merge

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec(PATH).ranks, special_tokens={})


def test_the_library_gives_the_same_ids(spark, docs_of, library):
    rng = random.Random(12)
    alphabet = list("abcdeéß ÀЖ中😀  \x1c\x85\n\t'!?.0123") + ["'s", "'ll", "<|endoftext|>", "the ", "ation"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(500)]
    rows += [(900, None), (901, ""), (901, ""), (None, "x"), (902, "aaaa" * 400 + " " * 333 + "\n" * 99), (903, "".join(rng.choice("abc") for _ in range(30_000)))]
    want = sorted(
        (str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
        for ids in [library.encode_ordinary(t or "")]
    )
    assert sorted((str(r[0]), *r[1:]) for r in bpe_round_trip(docs_of(rows), PATH).collect()) == want
    assert bpe_round_trip(docs_of(rows).limit(0), PATH).count() == 0
    ids = {r.doc_id: r.ids for r in bpe_round_trip(docs_of(rows[:20]), PATH, with_ids=True).collect()}
    assert all(ids[i] == library.encode_ordinary(t) for i, t in rows[:20])


def test_pieces_whose_merges_lead_back_to_lower_ranks():
    # b + c comes late, yet a + bc has an early rank.
    ranks = {bytes([k]): k for k in range(97, 103)} | {b"abc": 200, b"bc": 400, b"cd": 300, b"dd": 250, b"ddd": 210}
    queue = RankQueue(500)

    def plain(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(3)
    for _ in range(3_000):
        p = bytes(rng.choice(b"abcdef") for _ in range(rng.randint(1, 24)))
        assert merge(p, ranks, queue) == ([ranks[p]] if p in ranks else plain(p))
    assert queue.top == 0 and not queue.buckets


def test_queue_gives_the_least_rank_and_place():
    rng = random.Random(4)
    queue, held = RankQueue(50_000), []
    for _ in range(4_000):
        if held and rng.random() < 0.5:
            held.sort()
            assert queue.pop() == held.pop(0)
        else:
            x = (rng.choice([rng.randrange(50_000), 7]), rng.randrange(10**6))
            held.append(x)
            queue.push(*x)


def test_a_long_piece_takes_little_time():
    assert len(codec(PATH).encode("ab" * 200_000)) > 0
