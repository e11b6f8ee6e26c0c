"""Rights classification, corpus quality, pack manifests and their drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import count_if
from ..schemas import KINDS, STATUSES
from .records import (
    AUTHORED_INTERNAL,
    BEHAVIOURAL_KINDS,
    FACTS_ONLY,
    PROJECT_AUTHORED,
    RE_FINGERPRINT,
    RE_RFC3339,
    is_advisory,
)

# Licence groups, reason codes, approved licence material, placeholder reviewers.
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0")
COPYLEFT_PREFIXES = ("gpl-", "agpl-", "lgpl-", "mpl-", "epl-")
CC_BY = r"^cc-by(-[0-9][0-9.]*)?\z"
UNRESOLVED = (
    "missing_evidence",
    "missing_source_url",
    "missing_notice_evidence",
    "missing_rights_review",
    "rights_digest_mismatch",
    "unapproved_license_text",
    "unrecognized_license",
)
APACHE_TEXT_SHA256 = "cfc7749b96f63bd31c3c42b5c471bf756814053e847c10f3eb003417bc523d30"
MIT_TEXT = """\
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
PLACEHOLDERS = ("todo", "tbd", "unknown", "n/a", "na", "placeholder", "example")
DEFAULT_POLICY = "rights-v1"
SENTINELS = {
    "": "missing_evidence",
    FACTS_ONLY: "facts_only",
    PROJECT_AUTHORED: "project_authored",
    AUTHORED_INTERNAL: "authored_internal",
}
COMMERCIAL = ("facts_only", "project_authored", "licensed_notice", "cc_by_notice")
NOTICE = ("licensed_notice", "cc_by_notice")
# What a reviewer is asked to do per reason code.
REMEDIATION = {
    "missing_evidence": "review provenance and record truthful rights evidence in a human-reviewed corpus PR",
    "missing_source_url": "verify the licensed source and record its immutable source URL in a human-reviewed corpus PR",
    "missing_notice_evidence": "collect complete source attribution, notice, and license text evidence in a human-reviewed corpus PR",
    "missing_rights_review": "complete or correct the immutable human rights-review attestation; never auto-populate it",
    "rights_digest_mismatch": "complete or correct the immutable human rights-review attestation; never auto-populate it",
    "unapproved_license_text": "keep excluded until the declared license has approved canonical material under a versioned policy",
    "unrecognized_license": "verify the source terms and record a supported SPDX license or keep the record excluded",
}
REMEDIATION_ELSE = "manual rights review required; keep the record excluded until resolved"


def license_code(license_: Column) -> Column:
    """Reason code of a licence id; anything unknown is excluded from commercial packs."""
    s = X.utrim(F.coalesce(license_, F.lit("")))
    low = F.lower(s)
    sentinel = F.create_map(*[F.lit(x) for kv in SENTINELS.items() for x in kv])
    copyleft = "^(" + "|".join(COPYLEFT_PREFIXES) + ")"
    return F.coalesce(
        sentinel[s],
        F.when(low.isin(*PERMISSIVE), "licensed_notice")
        .when(low.rlike(CC_BY), "cc_by_notice")
        .when(low.rlike("^cc-"), "restricted_cc")
        .when(low.rlike(copyleft), "copyleft")
        .otherwise("unrecognized_license"),
    )


def payload_column(columns: list[str]) -> Column:
    """Canonical payload of a record: its columns as one JSON text, in order."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def evidence_digest(columns: list[str]) -> Column:
    """Digest a reviewer attests to: path and canonical payload without the digest itself."""
    fields = [F.col(c) for c in columns if c != "provenance"]
    prov = F.col("provenance").withField("rights_review", F.col("provenance.rights_review").withField("evidence_sha256", F.lit("")))
    body = F.to_json(F.struct(*fields, prov.alias("provenance")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce("path", F.lit("")), F.lit("\n"), body), 256))


def classify_rights(records: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``rights``: struct(commercial, needs_notice, code).

    A licence that needs a notice also needs, in this order: source URL, notice evidence,
    approved licence text; every commercial record needs a matching human review.
    """
    p = lambda name: F.col(f"provenance.{name}")
    license_ = F.lower(X.utrim(F.coalesce(p("source_license"), F.lit(""))))
    att = lambda name: ~X.is_blank(p(f"source_attribution.{name}"))
    text = F.coalesce(p("source_attribution.license_text"), F.lit(""))
    notice_ok = att("license_text") & (
        F.when(license_.rlike(CC_BY), att("creator") & att("title") & att("license_url") & att("changes"))
        .when(license_ == "mit", att("copyright_notice"))
        .otherwise(att("copyright_notice") & att("notice"))
    )
    text_ok = (
        F.when(license_ == "mit", X.utrim(text) == MIT_TEXT.strip())
        .when(license_ == "apache-2.0", F.sha2(text, 256) == APACHE_TEXT_SHA256)
        .otherwise(F.lit(False))
    )
    rv = lambda name: F.coalesce(p(f"rights_review.{name}"), F.lit(""))

    def placeholder(c: Column) -> Column:
        v = F.lower(X.utrim(c))
        return (v == "") | v.isin(*PLACEHOLDERS) | F.contains(v, F.lit("<reviewer>")) | F.contains(v, F.lit("replace me"))

    review_ok = (
        ~placeholder(rv("reviewer"))
        & (rv("policy") == policy)
        & ~X.is_blank(rv("evidence_sha256"))
        & rv("source_sha256").rlike(RE_FINGERPRINT)
        & rv("reviewed_at").rlike(RE_RFC3339)
    )
    digest_ok = rv("evidence_sha256") == evidence_digest(records.columns)
    base = F.col("_code")
    needs, commercial = base.isin(*NOTICE), base.isin(*COMMERCIAL)
    code = (
        F.when(needs & X.is_blank(p("source_url")), "missing_source_url")
        .when(needs & ~notice_ok, "missing_notice_evidence")
        .when(needs & ~text_ok, "unapproved_license_text")
        .when(commercial & ~review_ok, "missing_rights_review")
        .when(commercial & ~digest_ok, "rights_digest_mismatch")
    )
    final = F.col("_final")
    rights = F.struct(final.isin(*COMMERCIAL).alias("commercial"), needs.alias("needs_notice"), final.alias("code"))
    coded = records.withColumn("_code", license_code(p("source_license"))).withColumn("_final", F.coalesce(code, base))
    return coded.withColumn("rights", rights).drop("_code", "_final")


def rights_audit(records: DataFrame, policy: str = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buckets, findings, queue): counts per reason code, one finding per record, and the remediation
    queue with what is to be done; nothing in it is changed automatically."""
    unresolved = F.col("code").isin(*UNRESOLVED)
    findings = classify_rights(records, policy).select(
        "id",
        "path",
        "status",
        X.utrim(F.coalesce("provenance.source_license", F.lit(""))).alias("source_license"),
        X.utrim(F.coalesce("provenance.source_url", F.lit(""))).alias("source_url"),
        "rights.*",
    ).withColumn("unresolved", unresolved)
    buckets = findings.groupBy("code").agg(F.count("*").alias("count"))
    # A lookup table of constants: as an expression it would repeat the whole classification.
    actions = records.sparkSession.createDataFrame(list(REMEDIATION.items()), "code string, action string")
    queue = findings.where("unresolved").join(F.broadcast(actions), "code", "left").select(
        "id", "path", "code", "source_license", "source_url",
        F.coalesce("action", F.lit(REMEDIATION_ELSE)).alias("action"), F.lit(False).alias("automatic_change"),
    )
    return buckets, findings, queue


def rights_totals(findings: DataFrame) -> DataFrame:
    """(total_records, commercial_eligible, needs_notice, unresolved_evidence) of the findings."""
    return findings.agg(
        F.count("*").alias("total_records"),
        count_if(F.col("commercial")).alias("commercial_eligible"),
        count_if(F.col("commercial") & F.col("needs_notice")).alias("needs_notice"),
        count_if(F.col("unresolved")).alias("unresolved_evidence"),
    )


def corpus_quality(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(metric, key, count): one long table of the quality report, known statuses and kinds seeded with 0.

    ``files`` (path) lists existing corpus files; a declared repro runs when it is a file, or a
    folder holding ``repro.sh``.
    """
    p = "provenance"
    repro_list = F.array_compact(
        F.concat(
            F.array(F.when(~X.is_blank("guard.repro"), F.col("guard.repro"))),
            F.transform(
                F.coalesce(F.col("guard.repros"), F.array().cast("array<struct<path:string,kind:string,label:string>>")),
                lambda r: F.when(~X.is_blank(r["path"]), r["path"]),
            ),
        )
    )
    license_ = X.utrim(F.coalesce(f"{p}.source_license", F.lit("")))
    facts = records.select(
        "status",
        "kind",
        ((F.col("status") == "validated") & F.col("kind").isin(*BEHAVIOURAL_KINDS) & ~is_advisory()).alias("actionable"),
        F.col("guard").isNotNull().alias("guarded"),
        repro_list.alias("repros"),
        (~X.is_blank(f"{p}.source.author")).alias("authored"),
        license_.alias("license"),
        (~X.is_blank(f"{p}.source_url")).alias("linked"),
    )
    totals = facts.agg(
        F.count("*").alias("total_records"),
        count_if(F.col("actionable")).alias("validated_actionable_behavioral"),
        count_if(F.col("guarded")).alias("records_with_guard"),
        F.coalesce(F.sum(F.size("repros")), F.lit(0)).alias("declared_repros"),
        count_if(F.col("authored")).alias("coverage_provenance"),
        count_if(F.col("license") != "").alias("coverage_source_license"),
        count_if(F.col("linked")).alias("coverage_source_url"),
        *[count_if(F.col("status") == s).alias(f"status:{s}") for s in STATUSES],
        *[count_if(F.col("kind") == k).alias(f"kind:{k}") for k in KINDS],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("count")) for c in totals.columns])
    long = totals.select(F.inline(pairs)).select(
        F.when(F.contains("name", F.lit(":")), F.substring_index("name", ":", 1)).otherwise(F.col("name")).alias("metric"),
        F.when(F.contains("name", F.lit(":")), F.substring_index("name", ":", -1)).otherwise(F.lit("")).alias("key"),
        "count",
    )
    licenses = facts.groupBy(F.when(F.col("license") == "", "missing").otherwise(F.col("license")).alias("key")).agg(
        F.count("*").alias("count")
    )
    out = long.unionByName(licenses.select(F.lit("license").alias("metric"), "key", "count"))
    if files is not None:
        declared = facts.select(F.explode("repros").alias("declared"))
        clean = declared.where(~F.col("declared").startswith("/") & ~F.col("declared").rlike(r"(^|/)\.\.(/|$)")).select(
            F.rtrim("declared", F.lit("/")).alias("declared")
        )
        known = files.select("path").distinct()
        stage = known.unionByName(
            known.where(F.col("path").endswith("/repro.sh")).select(F.regexp_replace("path", "/repro.sh$", "").alias("path"))
        ).distinct()
        runnable = clean.join(stage, clean.declared == stage.path, "left_semi").agg(F.count("*").alias("count"))
        out = out.unionByName(runnable.select(F.lit("runnable_repros").alias("metric"), F.lit("").alias("key"), "count"))
    return out


def pack_tables(
    records: DataFrame, commercial: bool = True, include_quarantined: bool = False, policy: str = DEFAULT_POLICY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(included, excluded, attribution) of a pack.

    included is (id, path, sha256 of the payload); excluded carries a reason.
    """
    columns = records.columns
    c = classify_rights(records, policy).withColumn(
        "reason",
        F.when((F.col("status") != "validated") & F.lit(not include_quarantined), F.concat(F.lit("status:"), "status")).when(
            F.lit(commercial) & ~F.col("rights.commercial"), F.col("rights.code")
        ),
    )
    included = c.where(F.col("reason").isNull())
    digest = lambda col: F.concat(F.lit("sha256:"), F.sha2(F.coalesce(col, F.lit("")), 256))
    a = lambda name: F.col(f"provenance.source_attribution.{name}")
    present = F.col("provenance.source_attribution").isNotNull()
    some = lambda name, suffix: F.when(
        F.coalesce(a(name), F.lit("")) != "", F.concat(F.lit("THIRD_PARTY/"), "id", F.lit(suffix))
    )
    attribution = included.where("rights.needs_notice").select(
        "id",
        F.col("provenance.source_license").alias("source_license"),
        F.col("provenance.source_url").alias("source_url"),
        a("creator").alias("creator"),
        a("title").alias("title"),
        a("license_url").alias("license_url"),
        a("changes").alias("changes"),
        F.when(present, F.concat(F.lit("THIRD_PARTY/"), "id", F.lit("-LICENSE.txt"))).alias("license_file"),
        F.when(present, digest(a("license_text"))).alias("license_sha256"),
        some("copyright_notice", "-COPYRIGHT.txt").alias("copyright_file"),
        F.when(some("copyright_notice", "").isNotNull(), digest(a("copyright_notice"))).alias("copyright_sha256"),
        some("notice", "-NOTICE.txt").alias("notice_file"),
        F.when(some("notice", "").isNotNull(), digest(a("notice"))).alias("notice_sha256"),
    )
    payload = payload_column(columns)
    return (
        included.select("id", "path", digest(payload).alias("sha256")),
        c.where(F.col("reason").isNotNull()).select("id", "reason"),
        attribution,
    )


def pack_drift(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, sha256, side): ledger entries on one side only; 'missing' from or 'unexpected' in the pack.

    One signed count per entry; what is left over of it is repeated as often.
    """
    signed = lambda df, n: df.select("path", "sha256", F.lit(n).alias("n"))
    left = signed(manifest, 1).unionByName(signed(actual, -1)).groupBy("path", "sha256").agg(F.sum("n").alias("n")).where("n <> 0")
    return left.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n")))).select(
        "path", "sha256", F.when(F.col("n") > 0, "missing").otherwise("unexpected").alias("side")
    )
