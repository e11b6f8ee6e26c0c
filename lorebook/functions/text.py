"""Text column expressions: normalisation, tokens, shingles, hashes, entropy.

All of them are built-in expressions, so they stay inside whole-stage codegen.
The corpus is multilingual, so word boundaries and whitespace are spelled out as
ASCII classes: the JVM's own ``\\b`` and ``\\s`` differ from RE2's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII look-arounds for the two sides of a word, whitespace and non-whitespace.
LB = r"(?<![0-9A-Za-z_])"
RB = r"(?![0-9A-Za-z_])"
S = r"[\t\n\f\r ]"
NS = r"[^\t\n\f\r ]"
# Unicode white space (outer trim and field splitting).
UNICODE_SPACES = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# The replacements of signature normalisation, in their normative order.
SIGNATURE_RULES = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"0x[0-9a-f]+", "<addr>"),
    (LB + r"[0-9a-f]{8,}+" + RB, "<hex>"),
    (r"(^|" + S + r")(?:~|\.{1,2})?/" + NS + "+", "$1<path>"),
    (LB + r"[0-9]++" + RB, "<num>"),
    (S + "+", " "),
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(UNICODE_SPACES))


def is_blank(c) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(utrim(c), F.lit("")) == ""


def normalize_signature(c) -> Column:
    out = F.lower(utrim(c))
    for pattern, replacement in SIGNATURE_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return utrim(out)


def generic_fingerprint(c) -> Column:
    """Fingerprint of a signature that matches across repositories."""
    return _fingerprint(F.concat(F.lit("generic\n"), normalize_signature(c)))


def app_fingerprint(c, repo) -> Column:
    """Fingerprint of a signature scoped to one repository."""
    return _fingerprint(F.concat(F.lit("app\n"), repo, F.lit("\n"), normalize_signature(c)))


def _fingerprint(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def _non_empty(arr: Column) -> Column:
    return F.array_remove(arr, "")


def terms(c) -> Column:
    """Index terms: lower-cased maximal runs of letters and numbers."""
    return _non_empty(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"))


def words(c) -> Column:
    """Words for shingles: lower-cased maximal runs of letters and decimal digits."""
    return _non_empty(F.split(F.lower(col(c)), r"[^\p{L}\p{Nd}]+"))


def fields(c) -> Column:
    """White-space separated fields (all white space becomes a blank, a literal split is cheap)."""
    return _non_empty(F.split(F.translate(col(c), UNICODE_SPACES, BLANKS), " "))


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{Nd}]")


# Control characters that do not separate fields.
CONTROLS = "".join(chr(c) for c in (*range(0x20), *range(0x7F, 0xA0)) if chr(c) not in UNICODE_SPACES)
BLANKS = " " * len(UNICODE_SPACES)


def query_tokens(c) -> Column:
    """Fields that can match something: control characters removed, alphanumeric inside."""
    plain = F.translate(col(c), UNICODE_SPACES + CONTROLS, BLANKS)
    return F.filter(_non_empty(F.split(plain, " ")), has_alnum)


def seamed_phrases(c) -> Column:
    """The terms of each of :func:`query_tokens`, with U+0001 (a control character, which no token holds) for each run
    of other characters; also empty ones.  One pass over the text instead of one for each token."""
    plain = F.lower(F.translate(col(c), UNICODE_SPACES + CONTROLS, BLANKS))
    # First fields that are no token, as numbers alone don't make one of a field.
    return F.split(F.regexp_replace(plain, r"(?<![^ ])[^\p{L}\p{Nd} ]+(?![^ ])|[^\p{L}\p{N} ]+", "\u0001"), " ")


def ngrams(arr: Column, n: int) -> Column:
    """Space-joined n-grams of an array without nulls; empty when it is shorter than n.

    Words are taken one by one: a slice copies the whole array, so that a text's time would grow with
    the square of its length."""
    last = F.size(arr) - F.lit(n)
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(arr, i + F.lit(j)) for j in range(n)])),
    ).otherwise(F.array().cast("array<string>"))


def shingles(word_column: str, n: int = 5) -> Column:
    """Distinct n-grams of a column holding words.

    It takes a column, not an expression: the array is read once per n-gram, so it has to be
    computed (``withColumn("w", words("text"))``) before.
    """
    return F.array_distinct(ngrams(F.col(word_column), max(n, 1)))


def lines(c) -> Column:
    """Lines without their trailing carriage returns."""
    return F.transform(F.split(col(c), "\n"), lambda x: F.rtrim(x, F.lit("\r")))


def shannon_entropy(c: Column) -> Column:
    """Bits per character."""
    chars = F.split(c, "")
    n = F.size(chars)

    def bits(ch: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == ch)) / n
        return -p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc + bits(ch))


def mask(c: Column) -> Column:
    """First three and last two characters; short values are hidden entirely."""
    return F.when(F.length(c) <= 8, F.lit("****")).otherwise(
        F.concat(F.substring(c, 1, 3), F.lit("…"), F.substring(c, -2, 2))
    )


def salted_hash(salt: str, c) -> Column:
    """hex(sha256(salt + text)), first 16 bytes."""
    return F.substring(F.sha2(F.concat(F.lit(salt), col(c)), 256), 1, 32)


def record_id(n) -> Column:
    """Canonical record id of a number."""
    return F.format_string("exp-%04d", col(n).cast("bigint"))


def record_number(c) -> Column:
    """Numeric part of a record id; null when malformed."""
    return F.when(valid_id(c), F.substring(col(c), 5, 100).cast("bigint"))


def valid_id(c) -> Column:
    return F.coalesce(col(c).rlike(r"^exp-[0-9]{4,}\z"), F.lit(False))


def valid_hash(c) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9a-fA-F]{32}\z"), F.lit(False))


def strict_date(c) -> Column:
    """Date of a YYYY-MM-DD string; null when it is not one."""
    return F.when(col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(col(c), "yyyy-MM-dd"))


def slug(title) -> Column:
    """Lower-case title with each run of other characters collapsed to one dash."""
    s = F.regexp_replace(F.lower(col(title)), r"\p{C}", "")
    s = F.regexp_replace(s, r"[^a-z0-9]+", "-")
    s = F.btrim(s, F.lit("-"))
    return F.when(s == "", F.lit("record")).otherwise(s)
