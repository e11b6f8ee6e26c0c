"""Record-level filters, flattening, classification, validation and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import KINDS, STATUSES

# Kinds, id prefixes and patterns of the record grammar.
PUSH_KINDS = ("trap", "fix")
BEHAVIOURAL_KINDS = ("trap", "fix", "dead-end")
ALPHA_PREFIX = "alpha:"
ADVISORY_PREFIXES = ("GHSA-", "CVE-", "GO-")
FACTS_ONLY = "none (facts only)"
PROJECT_AUTHORED = "none (project-authored)"
AUTHORED_INTERNAL = "none (authored, internal-only)"
RE_FINGERPRINT = r"^sha256:[0-9a-f]{64}\z"
RE_PATH = r"^experience/([0-9]{4})/([0-9]{4,})-[a-z0-9-]+\.md\z"
RE_SPDX = r"^[A-Za-z0-9][A-Za-z0-9.+-]*\z"
RE_URL = r"^https?://[^\t\n\f\r ]+\z"
RE_RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def _strings(c) -> Column:
    return F.coalesce(X.col(c), F.array().cast("array<string>"))


def filter_status(df: DataFrame, include_quarantined: bool = False) -> DataFrame:
    """Validated records, optionally with quarantined ones."""
    return df.where(F.col("status").isin("validated", *(["quarantined"] if include_quarantined else [])))


def push_eligible(importers: Sequence[str] = ()) -> Column:
    """Validated, of an actionable kind, and neither imported nor from an alpha tenant."""
    origin = F.lower(F.col("origin"))
    ok = (F.col("status") == "validated") & F.col("kind").isin(*PUSH_KINDS) & ~origin.startswith(ALPHA_PREFIX)
    return ok & ~origin.isin(*[i.lower() for i in importers]) if importers else ok


def filter_push_eligible(df: DataFrame, importers: Sequence[str] = ()) -> DataFrame:
    return df.where(push_eligible(importers))


def flatten_records(df: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nested records -> (records, fingerprints, applies_to, texts).

    Within a record each fingerprint is kept once; an explicit one overrides the scope
    of a derived one, and generic overrides app.
    """
    sigs = _strings("symptom.error_signatures")
    records = df.select(
        F.col("id").alias("record_id"),
        "kind",
        "status",
        "title",
        F.coalesce(F.col("symptom.summary"), F.lit("")).alias("summary"),
        "path",
        F.lower(F.coalesce(F.col("provenance.source.author"), F.lit(""))).alias("origin"),
    )

    def scoped(arr: Column, scope: str, rank: int, fp) -> Column:
        return F.transform(
            arr, lambda s: F.struct(fp(s).alias("fp"), F.lit(scope).alias("scope"), F.lit(rank).alias("rank"))
        )

    found = F.concat(
        scoped(sigs, "generic", 0, X.generic_fingerprint),
        scoped(sigs, "app", 1, lambda s: X.app_fingerprint(s, F.lit(repo))),
        scoped(_strings("symptom.fingerprints.app"), "app", 2, lambda s: s),
        scoped(_strings("symptom.fingerprints.generic"), "generic", 3, lambda s: s),
    )
    fingerprints = (
        df.select(F.col("id").alias("record_id"), F.explode(found).alias("f"))
        .groupBy("record_id", F.col("f.fp").alias("fp"))
        .agg(F.max_by("f.scope", "f.rank").alias("scope"))
        .select("fp", "scope", "record_id")
    )
    applies_to = df.select(F.col("id").alias("record_id"), F.explode("applies_to").alias("a")).select(
        "record_id",
        F.coalesce(F.col("a.ecosystem"), F.lit("")).alias("ecosystem"),
        F.coalesce(F.col("a.package"), F.lit("")).alias("package"),
    )
    texts = df.select(
        F.col("id").alias("record_id"),
        "title",
        F.coalesce(F.col("symptom.summary"), F.lit("")).alias("summary"),
        F.array_join(sigs, "\n").alias("signatures"),
        "body",
    )
    return records, fingerprints, applies_to, texts


def eval_cases(df: DataFrame) -> DataFrame:
    """One retrieval probe per signature and one for the summary of served behavioural records."""
    probe = lambda q, source: F.struct(X.utrim(q).alias("query"), F.lit(source).alias("source"))
    probes = F.concat(
        F.transform(_strings("symptom.error_signatures"), lambda s: probe(s, "error_signature")),
        F.array(probe(F.coalesce(F.col("symptom.summary"), F.lit("")), "summary")),
    )
    return (
        df.where((F.col("status") == "validated") & F.col("kind").isin(*BEHAVIOURAL_KINDS) & F.col("symptom").isNotNull())
        .select(F.col("id").alias("record_id"), F.explode(probes).alias("p"))
        .select("record_id", "p.query", "p.source")
        .where(F.col("query") != "")
    )


def has_vuln_prefix(c) -> Column:
    return has_prefix(c, ADVISORY_PREFIXES)


def has_prefix(c, prefixes: Sequence[str]) -> Column:
    """Whether the trimmed, upper-cased text starts with one of the prefixes."""
    up = F.upper(X.utrim(c))
    out = up.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | up.startswith(p)
    return out


def own_signals() -> Column:
    """Signatures and explicit fingerprints of a record."""
    return F.concat(
        _strings("symptom.error_signatures"),
        _strings("symptom.fingerprints.app"),
        _strings("symptom.fingerprints.generic"),
    )


def is_advisory() -> Column:
    return F.exists(own_signals(), has_vuln_prefix)


def has_positive_repro() -> Column:
    repros = F.coalesce(
        F.col("guard.repros"), F.array().cast("array<struct<path:string,kind:string,label:string>>")
    )
    return ~X.is_blank("guard.repro") | F.exists(repros, lambda r: (r["kind"] == "positive") & ~X.is_blank(r["path"]))


def record_class() -> Column:
    return (
        F.when(is_advisory(), "advisory").when(has_positive_repro(), "proof").otherwise("prose")
    )


def classify_record_class(df: DataFrame) -> DataFrame:
    """Adds ``record_class``: advisory (vulnerability id), proof (positive repro) or prose."""
    return df.withColumn("record_class", record_class())


def actionable_behavioral(df: DataFrame) -> DataFrame:
    return df.where((F.col("status") == "validated") & F.col("kind").isin(*BEHAVIOURAL_KINDS) & ~is_advisory())


def substantive_root_cause() -> Column:
    """Whether a root cause is stated; a leading word 'none' or 'n/a' is not one."""
    s = F.lower(X.utrim(F.btrim(X.utrim(F.coalesce(F.col("resolution.root_cause"), F.lit(""))), F.lit("\"'"))))
    lead = F.ltrim(s, F.lit("\"'–—-.,;: "))
    return (s != "") & ~lead.rlike(r"^(none($|\P{L})|n/a)")


def route_records(df: DataFrame) -> DataFrame:
    """(id, route, reason): which lifecycle step may handle each record.

    Routes are advisory / prose / proof (promotion), repromotion, drafting or none;
    a quarantined record without a stated root cause may only be drafted.
    """
    status = F.col("status")
    quarantined = status == "quarantined"
    report = F.col("provenance.disputes").isNotNull()
    flagged = F.size(_strings("provenance.security_flags")) > 0
    proof = F.col("_proof")
    base = df.select(
        "id",
        "status",
        "provenance",
        record_class().alias("_class"),
        has_positive_repro().alias("_proof"),
        substantive_root_cause().alias("_cause"),
    )
    promotable = quarantined & F.col("_cause") & ~report & ~flagged
    route = (
        F.when(promotable, F.col("_class"))
        .when(status.isin("stale", "disputed") & ~flagged & proof, "repromotion")
        .when(quarantined & ~proof, "drafting")
        .otherwise("none")
    )
    reason = (
        F.when(~F.col("_cause"), "no_substantive_root_cause")
        .when(~quarantined, "not_quarantined")
        .when(report, "outcome_report")
        .when(flagged, "security_flagged")
        .otherwise("")
    )
    return base.withColumn("route", route).select(
        "id", "route", F.when(F.col("route").isin("none", "drafting"), reason).otherwise("").alias("reason")
    )


def blocking_flags() -> Column:
    """Stored consistency flags of a promotion-blocking class."""
    from .advisories import is_blocking_flag

    return F.filter(_strings("provenance.consistency_flags"), is_blocking_flag)


def validation_rules(now: str) -> list[tuple[str, Column]]:
    """(rule, violated) for every row rule; ``now`` is a YYYY-MM-DD date."""
    p = lambda name: F.col(f"provenance.{name}")
    status, kind = F.col("status"), F.col("kind")
    validated = status == "validated"
    episodic = kind.isin(*BEHAVIOURAL_KINDS)
    fixing = kind.isin(*PUSH_KINDS)
    repros = F.coalesce(
        F.col("guard.repros"), F.array().cast("array<struct<path:string,kind:string,label:string>>")
    )
    dead_ends = F.coalesce(
        F.col("resolution.dead_ends"), F.array().cast("array<struct<tried:string,why_it_failed:string>>")
    )
    panel = F.coalesce(
        p("promotion.panel"), F.array().cast("array<struct<judge_model:string,judge_decision:string>>")
    )
    repro_paths = F.filter(F.transform(repros, lambda r: r["path"]), lambda x: x != "")
    bad_date = lambda c: X.strict_date(c).isNull()
    symptom, resolution = F.col("symptom"), F.col("resolution")
    promo, demo = p("promotion"), p("demotion")
    attested = ~X.is_blank(p("promotion.attested_at"))
    needs_guard = validated & fixing & ~is_advisory() & ~(promo.isNotNull() & (F.size(panel) > 0))
    path_ok = F.coalesce(F.col("path").rlike(RE_PATH), F.lit(False))
    recorded, from_, until, valid_at = p("recorded_at"), p("valid.from"), p("valid.until"), p("validated_at")
    license_, url = F.coalesce(p("source_license"), F.lit("")), F.coalesce(p("source_url"), F.lit(""))
    usage = p("usage")
    no_match = lambda c, pattern: ~F.coalesce(X.col(c).rlike(pattern), F.lit(False))

    return [
        ("schema_version", F.coalesce(F.col("schema_version"), F.lit(0)) != 1),
        ("id_format", ~X.valid_id("id")),
        ("kind", ~F.coalesce(kind.isin(*KINDS), F.lit(False))),
        ("status", ~F.coalesce(status.isin(*STATUSES), F.lit(False))),
        ("title_length", ~F.coalesce(F.length("title").between(8, 120), F.lit(False))),
        ("body_empty", X.is_blank("body")),
        ("path_format", ~path_ok),
        ("path_id", path_ok & (F.concat(F.lit("exp-"), F.regexp_extract("path", RE_PATH, 2)) != F.col("id"))),
        (
            "path_year",
            path_ok & (F.length(recorded) >= 4) & (F.regexp_extract("path", RE_PATH, 1) != F.substring(recorded, 1, 4)),
        ),
        ("symptom_required", symptom.isNull() & episodic),
        ("symptom_summary", symptom.isNotNull() & X.is_blank("symptom.summary")),
        ("signature_blank", F.exists(_strings("symptom.error_signatures"), X.is_blank)),
        (
            "fingerprint_format",
            F.exists(
                F.concat(_strings("symptom.fingerprints.app"), _strings("symptom.fingerprints.generic")),
                lambda f: ~f.rlike(RE_FINGERPRINT),
            ),
        ),
        (
            "applies_to_empty",
            F.coalesce(
                F.exists(
                    "applies_to",
                    lambda a: (F.coalesce(a["ecosystem"], F.lit("")) == "")
                    & (F.coalesce(a["package"], F.lit("")) == "")
                    & (F.coalesce(F.size(F.map_keys(a["runtime"])), F.lit(0)) <= 0),
                ),
                F.lit(False),
            ),
        ),
        ("resolution_required", resolution.isNull() & episodic),
        ("root_cause_required", resolution.isNotNull() & fixing & X.is_blank("resolution.root_cause")),
        ("fix_required", resolution.isNotNull() & fixing & X.is_blank("resolution.fix")),
        ("dead_ends_required", resolution.isNotNull() & (kind == "dead-end") & (F.size(dead_ends) == 0)),
        (
            "dead_end_incomplete",
            F.exists(dead_ends, lambda d: X.is_blank(d["tried"]) | X.is_blank(d["why_it_failed"])),
        ),
        ("repro_path", F.exists(repros, lambda r: X.is_blank(r["path"]))),
        ("repro_kind", F.exists(repros, lambda r: ~F.coalesce(r["kind"].isin("positive", "negative"), F.lit(False)))),
        ("repro_duplicate", F.size(repro_paths) > F.size(F.array_distinct(repro_paths))),
        ("guard_required", needs_guard & X.is_blank("guard.guarding_test") & ~has_positive_repro()),
        ("author_required", X.is_blank(p("source.author"))),
        ("recorded_at_date", bad_date(recorded)),
        ("valid_from_date", bad_date(from_)),
        ("validated_at_date", valid_at.isNotNull() & bad_date(valid_at)),
        ("valid_until_date", until.isNotNull() & bad_date(until)),
        ("validated_at_required", validated & valid_at.isNull()),
        ("validated_security_flags", validated & (F.size(_strings(p("security_flags"))) > 0)),
        ("validated_consistency_flags", validated & (F.size(blocking_flags()) > 0)),
        ("validated_past_until", validated & F.coalesce(X.strict_date(until) < F.lit(now).cast("date"), F.lit(False))),
        ("validated_demotion", validated & demo.isNotNull()),
        ("superseded_by_required", (status == "superseded") & p("superseded_by").isNull()),
        ("superseded_until_required", (status == "superseded") & until.isNull()),
        ("superseded_by_format", p("superseded_by").isNotNull() & ~X.valid_id(p("superseded_by"))),
        ("disputes_format", p("disputes").isNotNull() & ~X.valid_id(p("disputes"))),
        ("promotion_evidence", promo.isNotNull() & (F.size(panel) == 0) & ~attested),
        ("panel_model", F.exists(panel, lambda v: X.is_blank(v["judge_model"]))),
        (
            "panel_decision",
            F.exists(panel, lambda v: X.utrim(F.coalesce(v["judge_decision"], F.lit(""))) != "approve"),
        ),
        ("promotion_model", promo.isNotNull() & X.is_blank(p("promotion.judge_model"))),
        (
            "promotion_decision",
            promo.isNotNull()
            & X.is_blank(p("promotion.judge_decision"))
            & (attested | ~X.is_blank(p("promotion.judge_model"))),
        ),
        ("demotion_attested_at", demo.isNotNull() & X.is_blank(p("demotion.attested_at"))),
        ("demotion_model", demo.isNotNull() & X.is_blank(p("demotion.judge_model"))),
        ("demotion_decision", demo.isNotNull() & X.is_blank(p("demotion.judge_decision"))),
        ("demotion_report", demo.isNotNull() & ~X.valid_id(p("demotion.report"))),
        ("validated_before_recorded", F.coalesce(X.strict_date(valid_at) < X.strict_date(recorded), F.lit(False))),
        ("until_before_from", F.coalesce(X.strict_date(until) < X.strict_date(from_), F.lit(False))),
        (
            "usage_negative",
            F.coalesce(
                F.least(p("usage.retrieved"), p("usage.pushed"), p("usage.confirmed_helpful")) < 0, F.lit(False)
            ),
        ),
        ("usage_last_hit", usage.isNotNull() & p("usage.last_hit").isNotNull() & bad_date(p("usage.last_hit"))),
        (
            "license_format",
            (license_ != "")
            & ~license_.isin(FACTS_ONLY, PROJECT_AUTHORED, AUTHORED_INTERNAL)
            & no_match(license_, RE_SPDX),
        ),
        ("source_url_format", (url != "") & no_match(url, RE_URL)),
        (
            "license_url_format",
            (F.coalesce(p("source_attribution.license_url"), F.lit("")) != "")
            & no_match(p("source_attribution.license_url"), RE_URL),
        ),
        *[
            (
                f"review_{name}",
                (F.coalesce(p(f"rights_review.{name}"), F.lit("")) != "") & no_match(p(f"rights_review.{name}"), pattern),
            )
            for name, pattern in (
                ("source_sha256", RE_FINGERPRINT),
                ("evidence_sha256", RE_FINGERPRINT),
                ("reviewed_at", RE_RFC3339),
            )
        ],
        ("internal_with_url", (license_ == AUTHORED_INTERNAL) & (url != "")),
        ("project_with_url", (license_ == PROJECT_AUTHORED) & (url != "")),
    ]


def violations_column(now: str) -> Column:
    """Array of violated rule names."""
    rules = [F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in validation_rules(now)]
    return F.array_compact(F.array(*rules))


def validate_records(df: DataFrame, now: str) -> DataFrame:
    """(id, path, rule): one row per violated row rule."""
    return df.select("id", "path", F.explode(violations_column(now)).alias("rule"))
