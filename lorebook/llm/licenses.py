"""License scans: exact phrases, and short notices found in spite of edits.

A notice within e edits holds one of its e + 1 pieces unchanged.  All pieces of all notices are
sought at once by an automaton; around each hit the ``regex`` library matches the whole notice
with at most e edits and reports its span and edits.  Each document is scanned in one pass of its
whole text in one task's memory; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, few_rows

# Phrases that are counted wherever their words stand one after another.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Notices as words in lower case.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
)
# Words that tell licenses apart: one that stands in a span but not in its notice vetoes the label.
NAMES = frozenset("mit apache gpl lgpl agpl lesser affero bsd mozilla mpl isc epl nc nd sa".split())
# One edit is allowed for this many characters of a notice, so pieces have about as many.
CHARACTERS_PER_EDIT = 8

# Upper case becomes lower case, other ASCII than letters and digits becomes a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(_FOLD).decode().split(" ")


def allowed_edits(notice: str) -> int:
    return max(1, len(notice) // CHARACTERS_PER_EDIT - 1)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece) for the e + 1 parts that a notice is split into."""
    parts = allowed_edits(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _scanner(notices: tuple[tuple[str, str], ...]):
    """The automaton over all pieces of the notices."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, notice) in enumerate(notices):
        for place, piece in pieces(notice):
            found.setdefault(piece, []).append((k, place))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton


@lru_cache(maxsize=64)
def _letters(notice: str) -> dict[str, int]:
    """For each character the bits of its places in the notice."""
    out: dict[str, int] = {}
    for i, c in enumerate(notice):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_edits(notice: str, joined: str, lo: int, hi: int) -> int:
    """Fewest edits between the notice and any part of a window; a column of the table is one number each
    for its steps up and down, so a character takes a few operations."""
    places, n = _letters(notice), len(notice)
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = every, 0, n, n
    for c in joined[lo:hi]:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        along = same | down
        rise, fall = (down | ~(across | up)) & every, up & across
        score += 1 if rise & last else -1 if fall & last else 0
        best = min(best, score)
        rise, fall = rise << 1 & every, fall << 1 & every
        up, down = (fall | ~(along | rise)) & every, rise & along
    return best


@lru_cache(maxsize=512)
def _pattern(notice: str, edits: int) -> regex.Pattern:
    return regex.compile(rf"(?:{regex.escape(notice)}){{e<={edits}}}")


def _matches(notice: str, joined: str, begins: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of a notice, none overlapping another: the best match around each place where a
    seed lets it begin.  Of overlapping ones that with fewer edits stays, then the first; the other is sought
    once more in what is left beside it.  Windows have a bounded length, so the time is linear."""
    n, e = len(notice), allowed_edits(notice)

    def best(lo: int, hi: int) -> tuple[int, int, int] | None:
        edits = least_edits(notice, joined, lo, hi)
        m = _pattern(notice, edits).search(joined, lo, hi) if edits <= e else None
        return (sum(m.fuzzy_counts), *m.span()) if m else None

    found: dict[tuple[int, int, int], tuple[int, int]] = {}
    first = None
    # Seeds of one place let it begin up to e apart: such share a window.
    ordered = sorted(set(begins))
    for i, begin in enumerate(ordered):
        first = begin if first is None else first
        if i + 1 < len(ordered) and ordered[i + 1] - first <= e:
            continue
        window = max(0, first - e), min(len(joined), begin + n + e)
        if m := best(*window):
            found.setdefault(m, window)
        first = None
    starts: list[int] = []
    kept: dict[int, tuple[int, int]] = {}
    todo = [(m, True, window) for m, window in found.items()]
    heapq.heapify(todo)

    def free(place: int) -> tuple[int, int]:
        at = bisect.bisect_right(starts, place)
        return kept[starts[at - 1]][0] if at else 0, starts[at] if at < len(starts) else len(joined)

    while todo:
        (edits, start, end), again, window = heapq.heappop(todo)
        low, high = free(start)
        if low <= start and end <= high:
            bisect.insort(starts, start)
            kept[start] = (end, edits)
        elif again:
            low, high = free((window[0] + window[1]) // 2)
            if m := best(max(low, window[0]), min(high, window[1])):
                heapq.heappush(todo, (m, False, window))
    return [(start, *kept[start]) for start in starts]


def _names_another(joined: str, start: int, end: int, notice: str) -> bool:
    """Whether the words that a span touches hold an exact name that the notice does not have."""
    start, end = joined.rfind(" ", 0, start + 1) + 1, joined.find(" ", end - 1)
    return not NAMES.isdisjoint(set(joined[start : end if end >= 0 else None].split()) - set(notice.split()))


def fuzzy_spans(joined: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of every notice in space-joined words, in order, none overlapping
    another of the same notice."""
    automaton = _scanner(notices)
    begins: dict[int, list[int]] = {}
    for end, (length, where) in automaton.iter(joined):
        for k, place in where:
            begins.setdefault(k, []).append(end - length + 1 - place)
    spans = []
    for k, places in begins.items():
        label, notice = notices[k]
        for start, end, edits in _matches(notice, joined, places):
            if not _names_another(joined, start, end, notice):
                spans.append((label, start, end, edits, k))
    return [s[:4] for s in sorted(spans, key=lambda s: (s[1], s[2], s[4]))]


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> dict:
    words = [w for w in words_of(text) if w]
    joined = " ".join(words)
    padded = f" {joined} "
    places, base = [], set()
    for label, phrase in PHRASES:
        sought = f" {phrase} "
        at, counted, word = padded.find(sought), 0, 0
        while at >= 0:
            word += padded.count(" ", counted, at)
            counted = at
            places.append(word)
            base.add(label)
            at = padded.find(sought, at + 1)
    spans = fuzzy_spans(joined, notices)
    likeness = [1 - edits / max(1, end - start) for _, start, end, edits in spans]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": 1.0 if base else max([0.0, *likeness]),
        "spans": [
            {"label": label, "first_word": joined.count(" ", 0, start), "text": joined[start:end], "edits": edits}
            for label, start, end, edits in spans
        ],
    }


_RESULT = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("text", pa.string()), ("edits", pa.int64())]))),
    ]
)


def license_scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for
    every row of ``docs`` (doc_id, text).

    ``spans`` holds (label, first_word, text, edits) of the notices found, the text as its words
    in lower case.  Score is 1 with an exact phrase, else the best share of unedited characters,
    else 0.  Null and empty texts have no words; repeated rows give repeated results; empty
    input an empty one.  Other columns are not read.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            found = pa.Table.from_pylist([scan(t.as_py(), notices) for t in b.column(1)], schema=_RESULT)
            rows = found.combine_chunks().to_batches()
            columns = rows[0].columns if rows else [pa.array([], f.type) for f in _RESULT]
            yield pa.record_batch([b.column(0), *columns], ["doc_id", *_RESULT.names])

    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first_word: bigint, text: string, edits: bigint>>",
    )


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
