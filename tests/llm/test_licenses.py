from __future__ import annotations

import random
import re
import time

import regex
from lorebook.llm.licenses import NOTICES, PHRASES, allowed_edits, fuzzy_spans, license_scan, scan


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min([i for i, _ in hits], default=None), max([i for i, _ in hits], default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places(spark, docs_of):
    rng = random.Random(1)
    parts = ["MIT", "License", "mit-license", "general", "PUBLIC", "licenses", "Apache\tLicense!", "é", "General Public\nLicense", "MIT License mit license", "x", "İ", "\x7f", "٣"]
    rows = [(i, rng.choice([" ", "\n", "é", ". "]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(900, None), (901, ""), (901, ""), (None, "mit license")]
    text = dict(rows)
    for r in license_scan(docs_of(rows)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan(docs_of(rows).limit(0)).count() == 0


def test_notices_with_edits_are_all_found():
    rng = random.Random(2)
    filler = "the of ation thing oner edth then rest lyst ound"
    for label, notice in NOTICES:
        for _ in range(30):
            s = list(notice)
            for _ in range(rng.randint(0, allowed_edits(notice))):
                k = rng.randrange(len(s))
                s[k] = rng.choice(["", "q", s[k] + "j"])
            text = f"{filler} {''.join(s)} {filler}"
            words = " ".join(text.split())
            whole = [m for k, n in NOTICES if k == label for m in regex.finditer(rf"(?b)(?:{n}){{e<={allowed_edits(n)}}}", words)]
            got = [x for x in fuzzy_spans(words) if x[0] == label]
            assert bool(got) == bool(whole), (notice, words)
            assert all(e <= max(allowed_edits(n) for k, n in NOTICES if k == label) for *_, e in got)


def test_a_span_reports_its_words_and_edits():
    r = scan("One two. Licensed under teh Apache Lisense, Version 2.0. end")
    assert r["labels"] == "apache" and r["base_labels"] == "" and 0.8 < r["score"] < 1
    assert r["spans"][0]["first_word"] == 2 and r["spans"][0]["edits"] == 3
    assert scan(None)["score"] == 0.0 and scan("a " * 50_000)["n_words"] == 50_000


def test_edited_notice_before_an_exact_one_and_names_of_other_licenses():
    text = "released undr the mit licens released under the mit license"
    assert [(r["text"].split()[0], r["edits"]) for r in scan(text)["spans"] if r["edits"] < 3] == [("released", 2), ("released", 0)]
    for other in ("released under the mpl license", "licensed under cc by sa 4 0"):
        assert scan(other)["spans"] == [] and scan(other)["score"] == 0
    assert scan("released under the mti license")["labels"] == "mit"


def test_many_edited_notices_take_linear_time():
    """Notices in one text, each with an edit: all are found, and time grows with the text."""
    rng = random.Random(5)
    notices = ["released under the mit license", "licensed under the apache license version 2 0", "subject to the terms of the mozilla public license"]

    def text(n):
        out = []
        for i in range(n):
            t = list(notices[i % 3])
            t[rng.randrange(9, len(t) - 9)] = "q"
            out.append("".join(t))
        return " ".join(out)

    took = []
    for n in (2_000, 20_000):
        joined = text(n)
        begin = time.perf_counter()
        spans = fuzzy_spans(joined)
        took.append(time.perf_counter() - begin)
        own = [s for s in spans if s[0] in ("mit", "apache", "mpl")]
        assert len(own) >= 0.9 * n and all(a[2] <= b[1] for a, b in zip(own, own[1:], strict=False) if a[0] == b[0])
    assert took[1] < 25 * took[0] and took[1] < 90


def test_overlapping_candidates_leave_both_notices():
    assert [s[0] for s in fuzzy_spans("released under the mit licensreleased under the mit license")] == ["mit", "mit"]
