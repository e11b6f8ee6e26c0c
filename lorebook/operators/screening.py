"""Content screening: hazards in free text, redaction, hashed telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import LB, RB, S

# Screening rules (category, rule, pattern), the assigned-secret pattern
# and the entropy (bits per character) from which an assigned value counts as random.
RULES = [
    ("secret", "aws-access-key", r"AKIA[0-9A-Z]{16}"),
    ("secret", "github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("secret", "github-pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("secret", "google-api-key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("secret", "slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("secret", "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("secret", "private-key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    ("harmful-code", "pipe-to-shell", rf"(?iu){LB}(?:curl|wget){RB}[^\n|]*\|{S}*(?:sudo{S}+)?(?:ba)?sh{RB}"),
    ("harmful-code", "base64-pipe-shell", rf"(?iu)base64{S}+-d[^\n|]*\|{S}*(?:ba)?sh{RB}"),
    ("harmful-code", "reverse-shell-devtcp", r"/dev/tcp/"),
    ("harmful-code", "netcat-exec", rf"(?iu){LB}nc{RB}[^\n]*{S}-e{S}"),
    ("harmful-code", "rm-rf-root", rf"{LB}rm{S}+-rf{S}+/(?:{S}|\z)"),
    ("harmful-code", "fork-bomb", rf":\(\){S}*\{{[^}}]*:\|:[^}}]*\}}{S}*;{S}*:"),
    ("pii", "email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    ("pii", "private-ip", rf"{LB}10(?:\.\d{{1,3}}){{3}}{RB}|{LB}192\.168(?:\.\d{{1,3}}){{2}}{RB}"),
]
ASSIGNED_SECRET = rf"(?iu)(?:api[_-]?key|secret|passwd|password|token){S}*[:=]{S}*['\"]?([A-Za-z0-9+/=_\-]{{20,}})"
ENTROPY_BITS = 3.5
PLACEHOLDERS = {"email": "<REDACTED-EMAIL>", "private-ip": "<REDACTED-IP>"}

FINDING = "struct<category:string,rule:string,redacted:string>"


def _finding(category: str, rule: str, match: Column) -> Column:
    return F.when(
        match.isNotNull(),
        F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), X.mask(match).alias("redacted")),
    )


def findings_column(texts: Column) -> Column:
    """Sorted array of hazards over an array of texts; each rule at most once, first match shown."""

    def first_match(pattern: str) -> Column:
        hits = F.transform(texts, lambda t: F.regexp_extract(F.coalesce(t, F.lit("")), pattern, 0))
        return F.get(F.filter(hits, lambda m: m != ""), F.lit(0))

    found = [_finding(category, rule, first_match(pattern)) for category, rule, pattern in RULES]
    assigned = F.flatten(
        F.transform(
            texts,
            lambda t: F.filter(
                F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(ASSIGNED_SECRET), F.lit(1)),
                lambda v: X.shannon_entropy(v) >= ENTROPY_BITS,
            ),
        )
    )
    found.append(_finding("secret", "assigned-high-entropy", F.get(assigned, F.lit(0))))
    return F.array_sort(F.array_compact(F.array(*found)))


def flags_column(findings: Column) -> Column:
    """Sorted 'category:rule' tags, free of secret material."""
    return F.array_sort(F.transform(findings, lambda f: F.concat(f["category"], F.lit(":"), f["rule"])))


def screen_corpus(texts: DataFrame, id_col: str = "id", texts_col: str = "texts") -> tuple[DataFrame, DataFrame]:
    """(findings, gates) of a table whose ``texts_col`` is an array of texts.

    A secret blocks a text from leaving; a secret or harmful code blocks execution.
    """
    scanned = texts.select(F.col(id_col).alias("id"), findings_column(F.col(texts_col)).alias("findings"))
    findings = scanned.select("id", F.inline("findings"))
    has = lambda *cats: F.exists("findings", lambda f: f["category"].isin(*cats))
    gates = scanned.select(
        "id",
        has("secret").alias("blocked"),
        (~has("secret", "harmful-code")).alias("executable"),
        flags_column(F.col("findings")).alias("flags"),
    )
    return findings, gates


def redact_pii(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, redacted, rules): e-mail addresses and private addresses replaced by placeholders."""
    redacted, rules = F.col(text_col), []
    for category, rule, pattern in RULES:
        if category == "pii":
            rules.append(F.when(F.col(text_col).rlike(pattern), F.lit(f"{category}:{rule}")))
            redacted = F.regexp_replace(redacted, pattern, PLACEHOLDERS[rule])
    return texts.select(
        F.col(id_col).alias("id"), redacted.alias("redacted"), F.array_compact(F.array(*rules)).alias("rules")
    )


def salted_hash_events(
    events: DataFrame, salt: str, query_col: str = "query", session_col: str = "session", keep_text: bool = False
) -> DataFrame:
    """Replace raw query and session by salted hashes; the raw query is dropped, or kept up to 256 bytes."""
    session = F.coalesce(F.col(session_col), F.lit(""))
    out = events.withColumn("query_hash", X.salted_hash(salt, query_col)).withColumn(
        "session_hash", F.when(session == "", F.lit("")).otherwise(X.salted_hash(salt, session))
    )
    if keep_text:
        # Cut at a character boundary: drop an incomplete trailing UTF-8 sequence.
        head = F.substring(F.encode(F.col(query_col), "UTF-8"), 1, 256)
        text = F.when(
            F.octet_length(query_col) > 256,
            F.regexp_replace(F.decode(head, "UTF-8"), "�+$", ""),
        ).otherwise(F.col(query_col))
        out = out.withColumn("query_text", text)
    return out.drop(query_col, *([] if session_col == "session_hash" else [session_col]))
