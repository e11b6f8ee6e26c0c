from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from lorebook.llm import personal
from lorebook.llm.personal import KINDS, op12_personal_data, personal_data

# The rules as they are told, one after another.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(RULES[kind], text or "") if holds(kind, m[0])]


def told(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def brute(rows, rounds=3, support=3, confidence=0.7):
    """The bootstrapping over dictionaries, mentions as the scan reports them."""
    scans = [personal.scan(t) for _, t in rows]
    edges, seed = {}, {}
    for s in scans:
        for m in s["mentions"]:
            if m["seed"]:
                seed.setdefault(m["i"], [0.0] * 4)[m["kinds"].bit_length() - 1] = 1.0
            for p in m["p"]:
                old = edges.get((p, m["i"]), (False, 0))
                edges[p, m["i"]] = max(old, (m["seed"], m["kinds"]))
    score, accepted = dict(seed), {}
    for _ in range(rounds):
        accepted = {}
        for p in {p for p, _ in edges}:
            mine = [i for q, i in edges if q == p]
            x = [sum(score.get(i, [0] * 4)[k] for i in mine) for k in range(4)]
            conf = [v / (len(mine) + 1) if v >= support and v / (len(mine) + 1) >= confidence else 0.0 for v in x]
            if any(conf):
                accepted[p] = conf
        missed = {}
        for (p, i), (is_seed, kinds) in edges.items():
            if p in accepted and not is_seed:
                old = missed.setdefault(i, [1.0] * 4)
                missed[i] = [old[k] * (1 - accepted[p][k]) if kinds >> k & 1 else old[k] for k in range(4)]
        score = {i: [1 - v for v in m] for i, m in missed.items()} | seed
    out = []
    for (doc, text), s in zip(rows, scans, strict=True):
        base = plain(text)
        found = []
        for m in s["mentions"]:
            best = max((accepted[p][k], -k) for p in [q for q in m["p"] if q in accepted] or [None] for k in range(4) if p and m["kinds"] >> k & 1) if not m["seed"] and any(q in accepted for q in m["p"]) else (0, 0)
            if best[0] > 0:
                found.append((-best[1], m["s"], m["e"]))
        counts = [sum(k == i for k, _, _ in base) for i in range(4)]
        out.append((doc, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(base + found), len(found)))
    return sorted(out, key=str)


def got(spark, docs_of, rows):
    df = personal_data(docs_of(rows))
    assert df.columns == ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_found"]
    return sorted(map(tuple, df.collect()), key=str)


def card(rng):
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if personal.luhn(d):
            return d


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    filler = lambda n: " ".join(word() for _ in range(n))
    phone = lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    rows, hidden, free = [], {}, set()
    for i in range(90):
        rows.append((i, f"{filler(20)} please call {phone()} {filler(9)}. My card number: {card(rng)}, thanks. E-mail: {word()}@mail{i}.example.com {filler(5)}"))
    # Forms that no rule takes, in contexts learnt from seeds, some of them only in the second round.
    for i in range(100, 130):
        local = f"0{rng.randint(100, 999)}/{rng.randint(1000000, 9999999)}"
        text = f"{filler(9)} please call {local} {filler(3)} ring back {local} now. {filler(4)} e-mail: {word()}@host{i} {filler(2)}"
        rows.append((i, text))
        hidden[i] = [f"phone:{m.start()}:{m.end()}" for m in re.finditer(re.escape(local), text)][:1] + [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\w+@host\d+", text)]
    for i in range(200, 205):
        text = f"{filler(9)} ring back 0{rng.randint(10, 99)}/{rng.randint(1000000, 9999999)} now"
        rows.append((i, text))
        m = re.search(r"0\d+/\d+", text)
        hidden[i] = [f"phone:{m.start()}:{m.end()}"]
    # Numbers of the same forms in no such context, and words alone.
    for i in range(300, 330):
        rows.append((i, f"{filler(12)} {word()} 0{rng.randint(100, 999)}/{rng.randint(1000000, 9999999)} {filler(6)}"))
        free.add(i)
    rows += [(400, None), (401, ""), (402, " \n"), (None, rows[0][1]), (3, rows[3][1]), (403, "please call 9999999 999 1234")]
    return rows, hidden, free


def test_equals_brute_force_and_finds_unseen_forms(spark, docs_of, corpus):
    rows, hidden, free = corpus
    out = got(spark, docs_of, rows)
    assert out == brute(rows)
    spans = {r[0]: r[6].split(",") for r in out}
    assert all(set(want) <= set(spans[i]) for i, want in hidden.items())
    assert all(spans[i] == [""] for i in free)


def test_given_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_personal_data(spark, sf).collect()), key=str) == brute(rows)
    assert any(plain(t) for _, t in rows)


def test_empty_table(spark, docs_of):
    assert got(spark, docs_of, []) == []


def test_seeds_equal_the_rules_on_random_texts():
    rng = random.Random(9)
    pieces = ["@", ".", "-", " ", "+", "(", ")", "1", "22", "300", "0001", "a", "b.c", "x_y", "é", "4111 1111 1111 1111", "+49 (30) 123-4567", "a@b.cd", "1.2.3.4", "\n", ":", "/", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))
        assert sorted(personal.base_spans(text)) == sorted(plain(text)), text
        found = personal.candidates(text, personal.base_spans(text))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert not any(s < e2 and s2 < e for s, e, _ in found for _, s2, e2 in plain(text))


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1(" * 400_000, "a@" * 400_000, "a@b." * 300_000, "1 " * 500_000, "f:" * 400_000, "+1 " * 400_000, "@ x" * 300_000])
def test_very_long_texts_take_linear_time(text):
    start = time.time()
    personal.scan(text)
    assert time.time() - start < 20
