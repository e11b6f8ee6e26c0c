"""Personal data: seed entities by rule, and identifiers in other forms found by bootstrapped contexts.

One scan of the whole texts finds the seeds (e-mail, IP, card and phone by fixed patterns and checks) and
the candidates: numbers and addresses that look like one of these kinds but don't pass its rule.
Each mention is put down with its lexical patterns, the words around it.  From then on there are
only hashes: Spark scores the graph of patterns and instances in rounds.

* A pattern's confidence for a kind is the share of its different instances that are of that kind,
  by the instances' scores, with one unknown instance added.  It is accepted from ``SUPPORT`` instances
  and a confidence of ``CONFIDENCE`` on.
* An instance's score for a kind is the noisy-or of its accepted patterns; seeds keep theirs.

Candidates in an accepted pattern of a kind that their form allows become spans.  Counts are of
different instances, so copies of a text add nothing; they are aggregates over all mentions, and
no list of a pattern or an instance is ever collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, few_rows, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS = 3.0, 0.7, 3
# Characters on either side in which a mention's neighbouring words are sought.
NEAR = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates: groups of digits with separators; whatever holds an at sign; groups of hex digits with colons.
_NUMBER = re.compile(r"[0-9][0-9().\-/]*+(?:\x20\(?[0-9][0-9().\-/]*+)*+")
_ADDRESS = re.compile(r"@[^\x20\x09-\x0D]*+")
_COLONS = re.compile(r"[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_BEFORE = frozenset(_SPACES + "(\"'<[{,;:=+*|")
_PUNCTUATION = "\"'()[]{}<>,.;!?*|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers each, from the left of every chain of them; numbers above 255 drop out."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in four)):
                    yield at, end
                at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _SPACED.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all seeds, by kind, then place."""
    return [(k, *span) for k, find in enumerate((emails, addresses, cards, phones)) for span in find(text)]


def kinds_of_form(form: str) -> int:
    """Bits of the kinds that a candidate's form allows: something at a host, groups with dots or colons,
    12 to 19 digits, 7 to 15 digits."""
    digits = sum("0" <= c <= "9" for c in form)
    if "@" in form:
        local, _, host = form.partition("@")
        return 1 if local and host and "@" not in host else 0
    if form.count(":") >= 2:
        return 2 if digits else 0
    return 2 * (form.count(".") >= 2 and digits >= 4) + 4 * (12 <= digits <= 19) + 8 * (7 <= digits <= 15)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, allowed kinds) of what looks like an identifier and touches no seed, in order."""
    found = []
    last = 0
    for m in _ADDRESS.finditer(text):
        start = max(last, *(text.rfind(c, last, m.start()) + 1 for c in _SPACES))
        found.append((start, m.end()))
        last = m.end()
    for pattern in (_COLONS, _NUMBER):
        for m in pattern.finditer(text):
            if m.start() == 0 or text[m.start() - 1] in _BEFORE:
                found.append(m.span())
    busy = sorted((s, e) for _, s, e in taken)
    out: list[tuple[int, int, int]] = []
    i, reach = 0, 0
    # The longer of two that begin together; then whatever begins behind the last one kept.
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        while start < end and text[end - 1] in _PUNCTUATION + ":/-":
            end -= 1
        while start < end and text[start] in _PUNCTUATION:
            start += 1
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        if start < reach or start >= end or (i < len(busy) and busy[i][0] < end):
            continue
        if allowed := kinds_of_form(text[start:end]):
            out.append((start, end, allowed))
            reach = end
    return out


def _word(raw: str) -> str:
    return raw.strip(_PUNCTUATION).lower()


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns of a mention: the word before it, the two words before it, the
    words on both sides.  Words are lower case without the marks around them."""
    before = [w for w in map(_word, text[max(0, start - NEAR) : start].split()) if w][-2:]
    after = next((w for w in map(_word, text[end : end + NEAR].split()) if w), "$")
    before = ["^"] * (2 - len(before)) + before
    told = (f"1 {before[1]}", f"2 {before[0]} {before[1]}", f"3 {before[1]} {after}")
    return [_signed(xxhash.xxh64_intdigest(t)) for t in told]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def instance(form: str) -> int:
    """Hash of a mention's letters and digits."""
    return _signed(xxhash.xxh64_intdigest("".join(c for c in form.lower() if c.isalnum() or c == "@")))


def scan(text: str | None) -> dict:
    text = text or ""
    base = base_spans(text)
    seeds = [(s, e, 1 << k, True) for k, s, e in base]
    others = [(s, e, allowed, False) for s, e, allowed in candidates(text, base)]
    told = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
    return {
        **{f"n_{name}": sum(k == i for k, _, _ in base) for i, name in enumerate(KINDS)},
        "base_sha256": hashlib.sha256(told.encode()).hexdigest(),
        "base": [{"k": k, "s": s, "e": e} for k, s, e in base],
        "mentions": [{"s": s, "e": e, "kinds": kinds, "seed": seed, "i": instance(text[s:e]), "p": patterns(text, s, e)} for s, e, kinds, seed in seeds + others],
    }


_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])
_MENTION = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kinds", pa.int32()), ("seed", pa.bool_()), ("i", pa.int64()), ("p", pa.list_(pa.int64()))])
_FOUND = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.list_(_SPAN)), ("mentions", pa.list_(_MENTION))])
_SCHEMA = (
    f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, base array<struct<k: int, s: bigint, e: bigint>>, "
    "mentions array<struct<s: bigint, e: bigint, kinds: int, seed: boolean, i: bigint, p: array<bigint>>>"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        rows = pa.Table.from_pylist([scan(t.as_py()) for t in b.column(1)], schema=_FOUND).combine_chunks().to_batches()
        columns = rows[0].columns if rows else [pa.array([], f.type) for f in _FOUND]
        yield pa.record_batch([b.column(0), *columns], ["doc_id", *_FOUND.names])


def _each_kind(make) -> list[Column]:
    return [make(k).alias(f"x{k}") for k in range(len(KINDS))]


def accepted_patterns(edges: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(p, x0 .. x3) of the patterns accepted for at least one kind, with their confidence for each (else 0).

    ``edges`` (p, i, kinds, seed): one row for each pattern and instance, with the kinds (bits) that the
    instance's form allows, or is of if it is a seed.
    """
    allowed = lambda k: F.col("kinds").bitwiseAND(1 << k) != 0
    seeds = stored(edges.where("seed").groupBy("i").agg(*[F.max(allowed(k).cast("double")).alias(f"x{k}") for k in range(len(KINDS))]))
    size = stored(edges.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    # Patterns with fewer instances can never be accepted.
    able = stored(edges.join(size.select("p"), "p", "left_semi"))
    scores, patterns = seeds, None
    for step in range(rounds):
        told = able.select("p", "i").join(scores, "i").groupBy("p").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(len(KINDS))])
        sure = lambda k: F.when((F.col(f"x{k}") >= support) & (F.col(f"x{k}") / (F.col("n") + 1) >= confidence), F.col(f"x{k}") / (F.col("n") + 1)).otherwise(0.0)
        found = told.join(size, "p").select("p", *_each_kind(sure))
        patterns = stored(found.where(" OR ".join(f"x{k} > 0" for k in range(len(KINDS)))))
        if step < rounds - 1:
            # Noisy-or over the accepted patterns, for the kinds that the form allows.
            missed = lambda k: F.sum(F.when(allowed(k), F.log(1 - F.col(f"x{k}"))).otherwise(0.0))
            new = able.where("NOT seed").join(patterns, "p").groupBy("i").agg(*_each_kind(lambda k: 1 - F.exp(missed(k))))
            scores = stored(seeds.union(new.join(seeds.select("i"), "i", "left_anti")))
    return patterns


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for every row of ``docs`` (doc_id, text).

    The counts and the digest are of the seeds; ``spans`` holds these and the ``n_found`` discovered ones as
    kind:start:end in code points, end exclusive, by kind, then start, comma-joined.  A discovered
    span has the kind of its surest pattern, the first of several.  Null and empty texts have none;
    repeated rows give repeated results; empty input an empty one.  Other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanned, _SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    pairs = mentions.select("i", "kinds", "seed", F.explode("p").alias("p"))
    # Allowed kinds follow from the form, which equal instances may write differently; a seed anywhere is a seed.
    edges = stored(pairs.groupBy("p", "i").agg(F.max("seed").alias("seed"), F.max(F.struct("seed", "kinds"))["kinds"].alias("kinds")))
    patterns = accepted_patterns(edges, rounds, support, confidence)
    met = mentions.where("NOT seed").select("row", "s", "e", "kinds", F.explode("p").alias("p")).join(patterns, "p")
    best = F.greatest(*[F.struct(F.when(F.col("kinds").bitwiseAND(1 << k) != 0, F.col(f"x{k}")).otherwise(0.0).alias("x"), F.lit(-k).alias("k")) for k in range(len(KINDS))])
    found = (
        met.select("row", "s", "e", best.alias("b")).groupBy("row", "s", "e").agg(F.max("b").alias("b")).where("b.x > 0")
        .groupBy("row").agg(F.collect_list(F.struct((-F.col("b.k")).alias("k"), "s", "e")).alias("found"))
    )
    none = F.expr("array()").cast("array<struct<k: int, s: bigint, e: bigint>>")
    found_too = rows.drop("mentions").join(found, "row", "left").withColumn("found", F.coalesce("found", none))
    name = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit(":"), s["s"].cast("string"), F.lit(":"), s["e"].cast("string"))
    return found_too.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256",
        F.array_join(F.transform(F.array_sort(F.concat("base", "found")), name), ",").alias("spans"), F.size("found").cast("long").alias("n_found"),
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
