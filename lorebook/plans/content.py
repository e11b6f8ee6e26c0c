"""Registered queries: records, screening, rights, advisories, drafts and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import advisories as A
from ..operators import ingest as I
from ..operators import records as RC
from ..operators import rights as RT
from ..operators import screening as SC
from ..operators import similarity as SM
from ..sources import feeds
from . import sqltext as Q
from .retrieval import ELIGIBLE, IMPORTERS, VALID, _tiers
from .tables import corpus, document_index, records, table

NOW = "2024-06-01"
SALT = "pepper"
REPO = "example.org/repo"


def _n(c):
    return F.col(c).cast("bigint").alias(c)


# ---------------------------------------------------------------- records


def filter_status(s, d):
    return RC.filter_status(records(s, d), include_quarantined=True).select("id", "status")


def filter_push_eligible(s, d):
    flat, *_ = RC.flatten_records(records(s, d), REPO)
    return RC.filter_push_eligible(flat, IMPORTERS).select("record_id", "origin")


def flatten_records(s, d):
    _, fingerprints, applies_to, texts = RC.flatten_records(records(s, d), REPO)
    counts = fingerprints.groupBy("record_id").agg(
        F.count("*").alias("fingerprints"), F.count(F.when(F.col("scope") == "app", 1)).alias("app_scoped"), F.min("fp").alias("first_fp")
    )
    return texts.join(applies_to, "record_id").join(counts, "record_id", "left").select(
        "record_id", "ecosystem", "package", "summary",
        F.length("signatures").cast("bigint").alias("signature_chars"), F.length("body").cast("bigint").alias("body_chars"),
        F.coalesce("fingerprints", F.lit(0)).alias("fingerprints"), F.coalesce("app_scoped", F.lit(0)).alias("app_scoped"),
        F.coalesce("first_fp", F.lit("")).alias("first_fp"),
    )


def eval_cases(s, d):
    return RC.eval_cases(records(s, d))


def classify_record_class(s, d):
    return RC.classify_record_class(_advisory_records(s, d).unionByName(records(s, d))).select("id", "record_class")


def actionable_behavioral(s, d):
    return RC.actionable_behavioral(records(s, d)).select("id", "kind")


def validate_records(s, d):
    return RC.validate_records(records(s, d), NOW)


def route_records(s, d):
    return RC.route_records(records(s, d))


def corpus_quality(s, d):
    return RT.corpus_quality(records(s, d))


# ---------------------------------------------------------------- near copies


def containment_join(s, d):
    drafts = table(s, d, "documents").select(X.record_id("doc_id").alias("draft_id"), "text")
    refs = table(s, d, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
    return SM.containment_join(drafts, refs, with_matches=True).select(
        "draft_id", "ref_id", "shared", _n("total"), F.round("containment", 6).alias("containment"), F.element_at("matches", 1).alias("first_match"),
    )


def leak_and_relevance_guard(s, d):
    own = table(s, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("task_id"), X.record_id("doc_id").alias("record_id"), F.col("text").alias("prompt")
    )
    turns = table(s, d, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"),
        X.record_id("conv_id").alias("record_id"), F.col("text").alias("prompt"),
    )
    out = SM.leak_and_relevance_guard(own.unionByName(turns), records(s, d))
    return out.withColumn("containment", F.round("containment", 6))


# ---------------------------------------------------------------- screening


def _screened(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.array("text").alias("texts"))
    turns = table(s, d, "conversations").select(
        F.concat_ws("/", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.array("text").alias("texts")
    )
    return SC.screen_corpus(docs.unionByName(turns))


def screen_findings(s, d):
    return _screened(s, d)[0]


def screen_gates(s, d):
    return _screened(s, d)[1].withColumn("flags", F.array_join("flags", ","))


def redact_pii(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return SC.redact_pii(docs).withColumn("rules", F.array_join("rules", ","))


def salted_hash_events(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.col("conv_id").cast("string").alias("session"))
    return SC.salted_hash_events(turns, SALT)


# ---------------------------------------------------------------- rights


def classify_rights(s, d):
    return RT.classify_rights(records(s, d)).select("id", "rights.*")


def rights_audit_buckets(s, d):
    return RT.rights_audit(records(s, d))[0]


def rights_remediation(s, d):
    return RT.rights_audit(records(s, d))[2]


def rights_totals(s, d):
    return RT.rights_totals(RT.rights_audit(records(s, d))[1])


def pack_selection(s, d):
    included, excluded, attribution = RT.pack_tables(records(s, d), commercial=False)
    return (
        included.select("id", F.lit("included").alias("part"), F.lit("").alias("detail"))
        .unionByName(excluded.select("id", F.lit("excluded").alias("part"), F.col("reason").alias("detail")))
        .unionByName(attribution.select("id", F.lit("attribution").alias("part"), F.col("source_license").alias("detail")))
    )


def pack_drift(s, d):
    docs = table(s, d, "documents")
    ledger = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    redacted = docs.join(SC.redact_pii(docs.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id"), "doc_id")
    actual = redacted.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("redacted", 256).alias("sha256"))
    return RT.pack_drift(ledger, actual)


# ---------------------------------------------------------------- advisories


def _osv(s, d):
    """Advisories from parts: types are ecosystems, sizes are versions."""
    size = F.col("p_size").cast("string")
    ev = lambda i, f: F.struct(F.lit(i).cast("string").alias("introduced") if i is None else i.alias("introduced"), F.lit(f).cast("string").alias("fixed") if f is None else f.alias("fixed"))
    two = F.array(ev(F.lit("0"), None), ev(None, F.concat(size, F.lit(".0.0"))), ev(F.concat(size, F.lit(".5.0")), None))
    one = F.array(ev(F.lit("1.0.0"), None))
    events = (
        F.when(F.col("p_size") % 3 == 0, two).when(F.col("p_size") % 3 == 1, one)
        .otherwise(F.array().cast("array<struct<introduced:string,fixed:string>>"))
    )
    ghsa = F.concat(F.lit("GHSA-"), F.lpad(F.hex("p_partkey"), 4, "0"), F.lit("-aaaa-bbbb"))
    eco = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.concat(F.lit("Go:v"), size)).otherwise("npm")
    name = F.when(F.col("p_size") > 30, F.concat(F.lit("https://"), "p_name")).otherwise(F.col("p_name"))
    return table(s, d, "part").select(
        F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") > 25, F.array(ghsa)).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("p_brand") == "Brand#7", "2024-01-01").otherwise("").alias("withdrawn"),
        F.array(
            F.struct(F.struct(eco.alias("ecosystem"), name.alias("name")).alias("package"), F.array(F.struct(events.alias("events"))).alias("ranges"))
        ).alias("affected"),
        F.array(F.struct(F.lit("WEB").alias("type"), F.concat(F.lit("https://github.com/advisories/"), ghsa).alias("url"))).alias("references"),
    )


def pair_version_ranges(s, d):
    return A.pair_version_ranges(_osv(s, d))


def _osv_drafts(s, d):
    return A.advisories_to_drafts(_osv(s, d), "Go")


def advisories_to_drafts(s, d):
    return _osv_drafts(s, d).select(
        F.col("draft_id").alias("id"), "title", F.col("symptom.summary").alias("summary"), F.col("resolution.fix").alias("fix"), "body", "source_url",
        F.size("applies_to").cast("bigint").alias("ranges"), F.array_join("symptom.error_signatures", ",").alias("signatures"),
    )


def _advisory_records(s, d):
    drafts = _osv_drafts(s, d).withColumn("id", X.record_id(F.regexp_extract("draft_id", r"(\d+)$", 1)))
    return I._quarantined(drafts, NOW, F.lit("importer"), F.lit(None))


def advisory_defects(s, d):
    r = _advisory_records(s, d)
    wrong = r.withColumn("resolution", F.col("resolution").withField("fix", F.lit("Upgrade past the fixed version."))).withColumn(
        "provenance", F.col("provenance").withField("source_url", F.concat("provenance.source_url", F.lit("/CVE-1999-1")))
    )
    return A.advisory_defects(wrong)


def advisory_audit(s, d):
    deps = table(s, d, "lineitem").select(
        F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("dep"),
        F.concat(F.lit("mod/"), F.col("l_partkey").cast("string")).alias("path"),
        F.concat(
            F.lit("v"), F.col("l_quantity").cast("int").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".0"),
            F.when(F.col("l_returnflag") == "R", "-rc1").when(F.col("l_returnflag") == "N", "+build").otherwise(""),
        ).alias("version"),
    )
    size = F.col("p_size").cast("string")
    versions = F.struct(
        F.when(F.col("p_size") > 10, F.concat(size, F.lit(".2"))).alias("introduced"),
        F.when(F.col("p_size") < 40, F.concat((F.col("p_size") + 10).cast("string"), F.lit(".0.0"))).alias("fixed"),
    )
    adv = table(s, d, "part").select(
        F.concat(F.lit("adv"), F.col("p_partkey").cast("string")).alias("id"),
        F.struct(
            F.array(
                F.lit("boom"),
                F.when(F.col("p_type") == "SMALL", F.lit("no id")).otherwise(F.concat(F.lit(" MAL-2024-"), F.col("p_partkey").cast("string"))),
            ).alias("error_signatures")
        ).alias("symptom"),
        F.array(
            F.struct(
                F.when(F.col("p_size") > 45, "npm").otherwise("GO").alias("ecosystem"),
                F.concat(F.lit("mod/"), F.col("p_partkey").cast("string")).alias("package"), versions.alias("versions"),
            )
        ).alias("applies_to"),
    )
    return A.advisory_audit(deps, adv)


def _cycle_rows(s, d):
    products = F.array(F.lit("go"), F.lit("nodejs"), F.lit("python"))
    eol = (
        F.when(F.col("n_regionkey") == 0, "true").when(F.col("n_regionkey") == 1, "false").when(F.col("n_regionkey") == 2, "2023-01-01")
        .when(F.col("n_regionkey") == 3, "2030-01-01").otherwise("")
    )
    return table(s, d, "nation").select(
        F.element_at(products, (F.col("n_nationkey") % 3 + 1).cast("int")).alias("product"), (F.col("n_nationkey") / 3).cast("int").cast("string").alias("cycle"), eol.alias("eol")
    )


def staleness(s, d):
    size = F.col("p_size")
    eco = F.when(size % 4 == 0, "Go").when(size % 4 == 1, "npm").when(size % 4 == 2, "PyPI").otherwise("cargo")
    pkg = F.when(F.col("p_type") == "SMALL", "github.com/x/y").when(F.col("p_type") == "LARGE", "io/util").otherwise("")
    until = F.when(F.col("p_brand") == "Brand#3", "2024-05-31").when(F.col("p_brand") == "Brand#4", "2024-06-01")
    fixed = F.when(size < 45, F.concat((size % 10).cast("string"), F.lit("."), (size % 2).cast("string"), F.lit(".3")))
    fixed = F.when(size % 5 == 0, (size % 10).cast("string")).otherwise(fixed)
    r = table(s, d, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"),
        F.when(F.col("p_brand") == "Brand#9", "stale").otherwise("validated").alias("status"),
        F.struct(F.struct(until.alias("until")).alias("valid")).alias("provenance"),
        F.array(F.struct(eco.alias("ecosystem"), pkg.alias("package"), F.struct(fixed.alias("fixed")).alias("versions"))).alias("applies_to"),
    )
    return A.staleness(r, _cycle_rows(s, d), NOW)


# ---------------------------------------------------------------- drafts


def _candidates(s, d):
    turns = table(s, d, "conversations")
    number = F.col("conv_id") * 100 + F.col("turn")
    return turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("draft_id"), X.record_id(number).alias("id"),
        F.lit("trap").alias("kind"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"),
        F.col("text").alias("root_cause"), F.col("text").alias("fix"), F.col("text").alias("body"),
    )


def prepare_drafts(s, d):
    out = I.prepare_drafts(I.candidates_to_drafts(_candidates(s, d)), document_index(s, d), NOW, floor=25.0)
    return out.select(
        "draft_id", "novelty", "outcome", F.array_join("rules", ",").alias("rules"),
        F.coalesce(F.array_join("record.provenance.security_flags", ","), F.lit("")).alias("flags"), F.col("record.path").alias("path"),
    )


def reports_to_counter_records(s, d):
    e = table(s, d, "events").where(F.col("event_type") == "error")
    reports = e.select(
        X.record_id("event_id").alias("id"),
        F.when(F.col("value") > 30, "not-an-id").otherwise(X.record_id(F.get_json_object("props", "$.k"))).alias("record_id"),
        F.when(F.col("value") > 10, "failed").otherwise("").alias("outcome"),
        F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("evidence"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.lit(None).cast("string").alias("session"),
    )
    out = I.reports_to_counter_records(reports, NOW)
    return out.select("id", "kind", "status", "title", F.col("provenance.disputes").alias("disputes"), F.col("resolution.dead_ends")[0]["why_it_failed"].alias("why"), "path", F.length("body").cast("bigint").alias("chars"))


def dedup_drafts(s, d):
    drafts = corpus(s, d).select(
        F.col("doc_id").alias("seq"), "title", F.struct(F.array(F.lit(" "), F.col("body")).alias("error_signatures")).alias("symptom"),
        (F.col("status") != "validated").alias("creatable"),
    )
    return I.dedup_drafts(drafts).select("seq", "creatable", "accepted", F.sha2("key", 256).alias("key_hash"))


def assign_ids(s, d):
    drafts = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"))
    known = [corpus(s, d).select("id"), table(s, d, "customer").select(X.record_id("c_custkey").alias("id"))]
    return I.assign_ids(drafts, known, floors=(321,))


def _order_records(s, d):
    o = table(s, d, "orders")
    status = F.col("o_orderstatus")
    return o, status


def integrity_check(s, d):
    o, status = _order_records(s, d)
    repro = lambda c: F.concat(F.lit("repro/"), c.cast("string"))
    r = o.select(
        X.record_id(F.when(status == "P", F.col("o_custkey")).otherwise(F.col("o_orderkey"))).alias("id"),
        F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.struct(F.when(status == "F", X.record_id(F.col("o_orderkey") + F.col("o_custkey"))).alias("superseded_by")).alias("provenance"),
        F.struct(
            F.when(status == "O", repro(F.col("o_orderkey"))).alias("repro"),
            F.array(F.struct(repro(F.col("o_custkey")).alias("path"), F.lit("positive").alias("kind"), F.lit("").alias("label"))).alias("repros"),
        ).alias("guard"),
    )
    files = table(s, d, "lineitem").select(repro(F.col("l_orderkey")).alias("path"))
    return I.integrity_check(r, files)


def head_base_id_collision(s, d):
    o, status = _order_records(s, d)
    rows = o.select(
        X.record_id("o_custkey").alias("id"), F.concat(F.lit("e/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"), "o_orderstatus"
    )
    return I.head_base_id_collision(rows.where("o_orderstatus = 'F'").select("id", "path"), rows.where("o_orderstatus <> 'P'").select("id", "path"))


# ---------------------------------------------------------------- feeds


def past_cycles(s, d):
    bal = F.col("c_acctbal")
    eol = (
        F.when(bal > 8000, "true").when(bal < 0, "false").when(bal < 1000, "").when(bal < 2000, "2024-13-01")
        .otherwise(F.concat(F.lit("20"), F.lpad((bal % 60).cast("int").cast("string"), 2, "0"), F.lit("-02-03")))
    )
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("product"), F.col("c_custkey").cast("string").alias("cycle"), eol.alias("eol"))
    return feeds.past_cycles(rows, NOW).withColumn("ended_on", F.coalesce(F.col("ended_on").cast("string"), F.lit("")))


def deprecated_packages(s, d):
    flag = F.when(F.col("p_type") == "SMALL", "true").when(F.col("p_type") == "LARGE", "false").when(F.col("p_type") == "ECONOMY", "use another").otherwise(F.lit(None))
    meta = table(s, d, "part").select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") == 7, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("version"), flag.alias("deprecated"),
    )
    return feeds.deprecated_packages(meta)


def changelog_breaking(s, d):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    entry = F.concat(
        F.lit("* [`abc`](https://x) - **(SEMVER-MAJOR)** **"), F.lower("o_orderpriority"), F.lit("**: drop f() of "), key,
        F.lit(" (Some One) [#"), key, F.lit("](https://example.org/pr/"), key, F.lit(")"),
    )
    line = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("## 2024-01-02, Version "), key, F.lit(" 'Name', @me")))
        .when(F.col("o_totalprice") > 250000, entry)
        .otherwise(F.concat(F.lit("* plain (SEMVER-MAJOR) "), key))
    )
    docs = table(s, d, "orders").groupBy(cust.alias("doc")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\r\n").alias("text")
    )
    return feeds.breaking_entries(docs, cap=None)


def readme_gotchas(s, d):
    c = corpus(s, d)
    text = F.concat(
        F.lit("# Intro\n## Not counted\n```js\nx\n```\n# 👀 Examples\n\n## Table of Contents\n```js\ny\n```\n## "), "title", F.lit("\nSome words.\n```js\n"), "summary",
        F.lit("\n```\n### 💡 Explanation:\n"), F.array_join("signatures", " "), F.lit("\n# Contributing\n## Late\n"),
    )
    docs = c.select(F.col("id").alias("doc"), text.alias("text"))
    return feeds.gotcha_sections(docs, cap=None)


def background_text(s, d):
    p = table(s, d, "pages")
    head = F.when(F.col("page_id") % 10 == 0, F.encode(F.lit("\0"), "UTF-8")).otherwise(F.encode(F.lit(" "), "UTF-8"))
    files = p.select(F.col("url").alias("path"), F.concat(head, F.encode("html", "UTF-8")).alias("content"))
    return feeds.text_files(files).select("path", F.length("text").cast("bigint").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_status, filter_push_eligible, flatten_records, eval_cases, classify_record_class, actionable_behavioral, validate_records,
        route_records, corpus_quality, containment_join, leak_and_relevance_guard, screen_findings, screen_gates, redact_pii,
        salted_hash_events, classify_rights, rights_audit_buckets, rights_remediation, rights_totals, pack_selection, pack_drift, pair_version_ranges,
        advisories_to_drafts, advisory_defects, advisory_audit, staleness, prepare_drafts, reports_to_counter_records, dedup_drafts,
        assign_ids, integrity_check, head_base_id_collision, past_cycles, deprecated_packages, changelog_breaking, readme_gotchas,
        background_text,
    )
}

# ---------------------------------------------------------------- SQL

FPS = f"""sig AS (SELECT record_id, unnest(signatures) AS t FROM corpus),
  fps AS (SELECT DISTINCT record_id, {Q.fingerprint('t')} AS fp, 'generic' AS scope FROM sig UNION
    SELECT DISTINCT record_id, 'sha256:' || sha256('app' || chr(10) || '{REPO}' || chr(10) || {Q.norm('t')}), 'app' FROM sig)"""

OSV = """osv AS (SELECT *, 'CVE-2024-' || p_partkey AS id, 'GHSA-' || lpad(upper(to_hex(p_partkey)), 4, '0') || '-aaaa-bbbb' AS ghsa,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Go:v' || p_size ELSE 'npm' END AS eco,
    CASE WHEN p_size > 30 THEN 'https://' || p_name ELSE p_name END AS rawname FROM part),
  pairs AS (SELECT id, eco, rawname, p_name, '0' AS introduced, p_size || '.0.0' AS fixed FROM osv WHERE p_size % 3 = 0
    UNION ALL SELECT id, eco, rawname, p_name, p_size || '.5.0', NULL FROM osv WHERE p_size % 3 = 0
    UNION ALL SELECT id, eco, rawname, p_name, '1.0.0', NULL FROM osv WHERE p_size % 3 = 1)"""

_URL = "CASE WHEN p_size > 25 THEN 'https://github.com/advisories/' || ghsa ELSE 'https://osv.dev/vulnerability/' || id END"
_SPAN = """CASE WHEN p_size % 3 = 0 THEN p_name || ' (introduced 0, fixed ' || p_size || '.0.0); ' || p_name || ' (introduced ' || p_size || '.5.0)'
    WHEN p_size % 3 = 1 THEN p_name || ' (introduced 1.0.0)' ELSE p_name END"""
OSV_DRAFTS = f"""drafts AS (SELECT id, p_partkey, p_name, p_size, ghsa, {_URL} AS source_url,
    id || ': vulnerability in ' || p_name AS title,
    CASE WHEN p_size > 25 THEN id || ' (' || ghsa || ')' ELSE id END || ': known vulnerability in ' || p_name AS summary,
    CASE WHEN p_size % 3 = 0 THEN 'Upgrade affected packages past the fixed version; see ' || {_URL} || '.'
      ELSE 'No fix is published yet (the advisory lists no fixed version); see ' || {_URL} || ' for status and mitigations.' END AS fix,
    'OSV advisory ' || id || ' affects ' || {_SPAN} || '. See ' || {_URL} || '.' AS body,
    CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS ranges,
    CASE WHEN p_size > 25 THEN id || ',' || ghsa ELSE id END AS signatures
  FROM osv WHERE p_brand <> 'Brand#7' AND starts_with(eco, 'Go'))"""

_RE2 = [
    ("secret", "aws-access-key", r"AKIA[0-9A-Z]{16}"),
    ("secret", "github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("secret", "github-pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("secret", "google-api-key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("secret", "slack-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("secret", "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("secret", "private-key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    ("harmful-code", "pipe-to-shell", r"(?i)\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b"),
    ("harmful-code", "base64-pipe-shell", r"(?i)base64\s+-d[^\n|]*\|\s*(?:ba)?sh\b"),
    ("harmful-code", "reverse-shell-devtcp", r"/dev/tcp/"),
    ("harmful-code", "netcat-exec", r"(?i)\bnc\b[^\n]*\s-e\s"),
    ("harmful-code", "rm-rf-root", r"\brm\s+-rf\s+/(?:\s|\z)"),
    ("harmful-code", "fork-bomb", r":\(\)\s*\{[^}]*:\|:[^}]*\}\s*;\s*:"),
    ("pii", "email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    ("pii", "private-ip", r"\b10(?:\.\d{1,3}){3}\b|\b192\.168(?:\.\d{1,3}){2}\b"),
]
_ASSIGNED = r"""(?i)(?:api[_-]?key|secret|passwd|password|token)\s*[:=]\s*['"]?([A-Za-z0-9+/=_\-]{20,})"""


def _mask(e):
    return f"CASE WHEN length({e}) <= 8 THEN '****' ELSE substr({e}, 1, 3) || '…' || right({e}, 2) END"


def findings_ctes(source: str) -> str:
    """found(id, category, rule, redacted) of ``source``(id, text)."""
    rules = " UNION ALL ".join(
        f"SELECT id, '{c}' AS category, '{r}' AS rule, regexp_extract(text, {Q.q(p)}) AS m FROM {source}" for c, r, p in _RE2
    )
    return f"""hit AS ({rules} UNION ALL SELECT id, 'secret', 'assigned-high-entropy',
      coalesce(list_filter(regexp_extract_all(text, {Q.q(_ASSIGNED)}, 1), lambda v: list_entropy(string_split(v, '')) >= 3.5)[1], '') FROM {source}),
  found AS (SELECT id, category, rule, {_mask('m')} AS redacted FROM hit WHERE m <> '')"""


SCREENED = """src AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c/' || conv_id || '/' || turn, text FROM conversations)"""
_EMAIL, _IP = Q.q(_RE2[13][2]), Q.q(_RE2[14][2])
_REDACT = f"regexp_replace(regexp_replace(text, {_EMAIL}, '<REDACTED-EMAIL>', 'g'), {_IP}, '<REDACTED-IP>', 'g')"


def _shingles(w, n=5):
    """Distinct word n-grams of the word-list column ``w``."""
    return f"list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


_GENERIC = ", ".join(Q.q(w) for w in SM.GENERIC_TASK_WORDS)


def _distinctive(e):
    return f"list_distinct(list_filter({Q.words(e)}, lambda w: strlen(w) >= 4 AND NOT list_contains([{_GENERIC}], w) AND NOT regexp_full_match(w, '\\p{{Nd}}+')))"


RIGHTS = f"""rights AS (SELECT *, CASE
    WHEN source_license IN ('Apache-2.0', 'MIT') AND source_url = '' THEN 'missing_source_url'
    WHEN source_license IN ('Apache-2.0', 'MIT') THEN 'missing_notice_evidence'
    WHEN source_license = 'none (facts only)' THEN 'missing_rights_review'
    WHEN source_license = '' THEN 'missing_evidence' WHEN source_license LIKE 'none (authored%' THEN 'authored_internal'
    WHEN source_license LIKE 'CC-%' THEN 'restricted_cc' WHEN source_license LIKE 'GPL-%' THEN 'copyleft' END AS code,
    source_license IN ('Apache-2.0', 'MIT') AS needs_notice FROM corpus)"""
_UNRESOLVED = ", ".join(Q.q(c) for c in RT.UNRESOLVED)
_ACTION = "CASE code " + " ".join(f"WHEN {Q.q(c)} THEN {Q.q(a)}" for c, a in RT.REMEDIATION.items()) + f" ELSE {Q.q(RT.REMEDIATION_ELSE)} END"

_BLANK = lambda e: f"{Q.utrim(e)} = ''"
_FIXING = "kind IN ('trap', 'fix')"
_FIXTEXT = "array_to_string(signatures, chr(10))"
_RULES = {
    "title_length": "NOT length(title) BETWEEN 8 AND 120",
    "body_empty": _BLANK("body"),
    "symptom_summary": _BLANK("summary"),
    "signature_blank": f"len(list_filter(signatures, lambda x: {_BLANK('x')})) > 0",
    "root_cause_required": f"{_FIXING} AND {_BLANK('summary')}",
    "fix_required": f"{_FIXING} AND {_BLANK(_FIXTEXT)}",
    "dead_ends_required": "kind = 'dead-end'",
    "guard_required": f"status = 'validated' AND {_FIXING}",
    "superseded_by_required": "status = 'superseded'",
    "superseded_until_required": "status = 'superseded'",
    "internal_with_url": "source_license = 'none (authored, internal-only)' AND source_url <> ''",
}
_LEAD = "ltrim(lower(trim(trim(trim(summary), '\"''')))" + ", '\"''–—-.,;: ')"
_CAUSE = f"(lower({Q.utrim('trim(' + Q.utrim('summary') + ', ' + Q.q(chr(34) + chr(39)) + ')')}) <> '' AND NOT regexp_matches({_LEAD}, '^(none($|\\P{{L}})|n/a)'))"

_SLUG = "CASE WHEN trim(regexp_replace(regexp_replace(lower(title), '\\p{C}', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'record' ELSE trim(regexp_replace(regexp_replace(lower(title), '\\p{C}', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') END"

CAND = f"""cand AS (SELECT conv_id || '/' || turn AS draft_id, {Q.rid('conv_id * 100 + turn')} AS id, string_split(text, chr(10))[1] AS title, text FROM conversations),
  queries AS (SELECT draft_id AS query_id, CASE WHEN {Q.utrim('text')} <> '' THEN {Q.utrim('text')} ELSE {Q.utrim('title')} END AS text FROM cand
    WHERE {Q.utrim('text')} <> '' OR {Q.utrim('title')} <> '')"""

_COUNTER = """rep AS (SELECT event_id, user_id, value, props, 'exp-' || printf('%04d', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS target,
    CASE WHEN value > 10 THEN 'failed' ELSE 'unspecified' END AS outcome FROM events WHERE event_type = 'error' AND value <= 30),
  rep2 AS (SELECT *, substr('Outcome report against ' || target || ' — reported ' || outcome, 1, 120) AS title,
    CASE WHEN value > 20 THEN props ELSE '' END AS evidence FROM rep)"""


def _ver(e):
    """Orderable version key of ``e`` (numeric core, trailing zeros trimmed, release last)."""
    core = f"split_part(regexp_replace(trim({e}), '^v', ''), '+', 1)"
    nums = f"list_transform(string_split(split_part({core}, '-', 1), '.'), lambda x: CAST(x AS BIGINT))"
    trimmed = f"({nums})[1:coalesce(list_max(list_transform(range(1, len({nums}) + 1), lambda i: CASE WHEN ({nums})[i] <> 0 THEN i ELSE 0 END)), 0)]"
    return f"row({trimmed}, CASE WHEN contains({core}, '-') THEN 0 ELSE 1 END)"


SQL = {
    "filter_status": f"WITH {Q.CORPUS} SELECT id, status FROM corpus WHERE status IN ('validated', 'quarantined')",
    "filter_push_eligible": f"WITH {Q.CORPUS} SELECT record_id, lower(author) AS origin FROM corpus WHERE {ELIGIBLE}",
    "flatten_records": f"""WITH {Q.CORPUS}, {FPS},
      n AS (SELECT record_id, count(*) AS fingerprints, count(*) FILTER (scope = 'app') AS app_scoped, min(fp) AS first_fp FROM fps GROUP BY 1)
      SELECT record_id, lang AS ecosystem, source AS package, summary, length({_FIXTEXT}) AS signature_chars, length(body) AS body_chars,
        coalesce(fingerprints, 0) AS fingerprints, coalesce(app_scoped, 0) AS app_scoped, coalesce(first_fp, '') AS first_fp FROM corpus LEFT JOIN n USING (record_id)""",
    "eval_cases": f"""WITH {Q.CORPUS}, c AS (SELECT * FROM corpus WHERE status = 'validated' AND kind <> 'convention'),
      p AS (SELECT record_id, {Q.utrim('x')} AS query, 'error_signature' AS source FROM (SELECT record_id, unnest(signatures) AS x FROM c)
        UNION ALL SELECT record_id, {Q.utrim('summary')}, 'summary' FROM c)
      SELECT record_id, query, source FROM p WHERE query <> ''""",
    "classify_record_class": f"""WITH {Q.CORPUS}, {OSV}, {OSV_DRAFTS}
      SELECT id, CASE WHEN len(list_filter(signatures, lambda x: regexp_matches(upper({Q.utrim('x')}), '^(GHSA-|CVE-|GO-)'))) > 0 THEN 'advisory' ELSE 'prose' END AS record_class FROM corpus
      UNION ALL SELECT {Q.rid('p_partkey')}, 'advisory' FROM drafts""",
    "actionable_behavioral": f"""WITH {Q.CORPUS} SELECT id, kind FROM corpus WHERE status = 'validated' AND kind <> 'convention'
      AND len(list_filter(signatures, lambda x: regexp_matches(upper({Q.utrim('x')}), '^(GHSA-|CVE-|GO-)'))) = 0""",
    "validate_records": f"WITH {Q.CORPUS} " + " UNION ALL ".join(f"SELECT id, path, '{r}' AS rule FROM corpus WHERE {c}" for r, c in _RULES.items()),
    "route_records": f"""WITH {Q.CORPUS}, c AS (SELECT *, {_CAUSE} AS cause FROM corpus),
      r AS (SELECT *, CASE WHEN status = 'quarantined' AND cause THEN 'prose' WHEN status = 'quarantined' THEN 'drafting' ELSE 'none' END AS route FROM c)
      SELECT id, route, CASE WHEN route = 'prose' THEN '' WHEN NOT cause THEN 'no_substantive_root_cause' WHEN status <> 'quarantined' THEN 'not_quarantined' ELSE '' END AS reason FROM r""",
    "corpus_quality": f"""WITH {Q.CORPUS},
      st AS (SELECT unnest(['quarantined', 'validated', 'stale', 'superseded', 'disputed']) AS k), kd AS (SELECT unnest(['trap', 'fix', 'dead-end', 'convention', 'workflow']) AS k)
      SELECT 'total_records' AS metric, '' AS key, count(*) AS count FROM corpus
      UNION ALL SELECT 'validated_actionable_behavioral', '', count(*) FILTER (status = 'validated' AND kind <> 'convention'
        AND len(list_filter(signatures, lambda x: regexp_matches(upper({Q.utrim('x')}), '^(GHSA-|CVE-|GO-)'))) = 0) FROM corpus
      UNION ALL SELECT 'records_with_guard', '', 0 UNION ALL SELECT 'declared_repros', '', 0
      UNION ALL SELECT 'coverage_provenance', '', count(*) FROM corpus
      UNION ALL SELECT 'coverage_source_license', '', count(*) FILTER (source_license <> '') FROM corpus
      UNION ALL SELECT 'coverage_source_url', '', count(*) FILTER (source_url <> '') FROM corpus
      UNION ALL SELECT 'status', k, count(record_id) FROM st LEFT JOIN corpus ON status = k GROUP BY k
      UNION ALL SELECT 'kind', k, count(record_id) FROM kd LEFT JOIN corpus ON kind = k GROUP BY k
      UNION ALL SELECT 'license', CASE WHEN source_license = '' THEN 'missing' ELSE source_license END, count(*) FROM corpus GROUP BY 2""",
    "containment_join": f"""WITH dw AS (SELECT {Q.rid('doc_id')} AS draft_id, {Q.words('text')} AS w FROM documents), ds AS (SELECT draft_id, {_shingles('w')} AS s FROM dw),
      rw AS (SELECT item_id AS ref_id, {Q.words('text')} AS w FROM benchmark), rs AS (SELECT ref_id, unnest({_shingles('w')}) AS sh FROM rw),
      d AS (SELECT draft_id, len(s) AS total, unnest(s) AS sh FROM ds)
      SELECT draft_id, ref_id, count(*) AS shared, max(total) AS total, round(count(*) / max(total), 6) AS containment,
        min(sh) AS first_match FROM d JOIN rs USING (sh) GROUP BY draft_id, ref_id HAVING count(*) / max(total) >= 0.15""",
    "leak_and_relevance_guard": f"""WITH {Q.CORPUS}, tasks AS (SELECT 'doc/' || doc_id AS task_id, {Q.rid('doc_id')} AS record_id, text AS prompt FROM documents
        UNION ALL SELECT conv_id || '/' || turn, {Q.rid('conv_id')}, text FROM conversations),
      fw AS (SELECT record_id, {Q.words("concat_ws(' ', summary, array_to_string(signatures, chr(10)))")} AS w, {_distinctive("concat_ws(' ', title, summary, array_to_string(signatures, ' '), source)")} AS terms FROM corpus),
      f AS (SELECT record_id, {_shingles('w')} AS fs, terms FROM fw),
      tw AS (SELECT *, {Q.words('prompt')} AS w, {_distinctive('prompt')} AS pt FROM tasks), ts AS (SELECT *, {_shingles('w')} AS ps FROM tw),
      j AS (SELECT * FROM ts JOIN f USING (record_id)),
      k AS (SELECT *, CASE WHEN len(ps) > 0 THEN len(list_intersect(ps, fs)) / len(ps) ELSE 0e0 END AS c FROM j)
      SELECT task_id, record_id, round(c, 6) AS containment, CASE WHEN c >= 0.15 THEN 'leak' WHEN len(terms) > 0 AND NOT list_has_any(terms, pt) THEN 'irrelevant' ELSE 'ok' END AS verdict FROM k""",
    "screen_findings": f"WITH {SCREENED}, {findings_ctes('src')} SELECT id, category, rule, redacted FROM found",
    "screen_gates": f"""WITH {SCREENED}, {findings_ctes('src')},
      a AS (SELECT id, bool_or(category = 'secret') AS blocked, bool_or(category IN ('secret', 'harmful-code')) AS unsafe, string_agg(category || ':' || rule, ',' ORDER BY category || ':' || rule) AS flags FROM found GROUP BY id)
      SELECT id, coalesce(blocked, false) AS blocked, NOT coalesce(unsafe, false) AS executable, coalesce(flags, '') AS flags FROM src LEFT JOIN a USING (id)""",
    "redact_pii": f"""SELECT doc_id AS id, {_REDACT} AS redacted,
      concat_ws(',', CASE WHEN regexp_matches(text, {_EMAIL}) THEN 'pii:email' END, CASE WHEN regexp_matches(text, {_IP}) THEN 'pii:private-ip' END) AS rules FROM documents""",
    "salted_hash_events": f"SELECT conv_id, turn, substr(sha256('{SALT}' || text), 1, 32) AS query_hash, substr(sha256('{SALT}' || conv_id), 1, 32) AS session_hash FROM conversations",
    "classify_rights": f"WITH {Q.CORPUS}, {RIGHTS} SELECT id, false AS commercial, needs_notice, code FROM rights",
    "rights_audit_buckets": f"WITH {Q.CORPUS}, {RIGHTS} SELECT code, count(*) AS count FROM rights GROUP BY code",
    "rights_remediation": f"WITH {Q.CORPUS}, {RIGHTS} SELECT id, path, code, source_license, source_url, {_ACTION} AS action, false AS automatic_change FROM rights WHERE code IN ({_UNRESOLVED})",
    "rights_totals": f"""WITH {Q.CORPUS}, {RIGHTS} SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS commercial_eligible, CAST(0 AS BIGINT) AS needs_notice,
      count(*) FILTER (code IN ({_UNRESOLVED})) AS unresolved_evidence FROM rights""",
    "pack_selection": f"""WITH {Q.CORPUS}, {RIGHTS} SELECT id, 'included' AS part, '' AS detail FROM rights WHERE {VALID}
      UNION ALL SELECT id, 'excluded', 'status:' || status FROM rights WHERE NOT {VALID}
      UNION ALL SELECT id, 'attribution', source_license FROM rights WHERE {VALID} AND needs_notice""",
    "pack_drift": f"""WITH l AS (SELECT source || '/' || doc_id AS path, sha256(text) AS a, sha256({_REDACT}) AS b FROM documents)
      SELECT path, a AS sha256, 'missing' AS side FROM l WHERE a <> b UNION ALL SELECT path, b, 'unexpected' FROM l WHERE a <> b""",
    "pair_version_ranges": f"WITH {OSV} SELECT id, eco AS ecosystem, rawname AS package, introduced, fixed FROM pairs",
    "advisories_to_drafts": f"WITH {OSV}, {OSV_DRAFTS} SELECT id, title, summary, fix, body, source_url, ranges, signatures FROM drafts",
    "advisory_defects": f"""WITH {OSV}, {OSV_DRAFTS}
      SELECT {Q.rid('p_partkey')} AS id, 'consistency:null-fixed-fix-text' AS flag, true AS blocking FROM drafts WHERE p_size % 3 <> 0
      UNION ALL SELECT {Q.rid('p_partkey')}, 'consistency:source-url-id-mismatch:CVE-1999-1', true FROM drafts
      UNION ALL SELECT {Q.rid('p_partkey')}, 'consistency:malformed-package-path:' || p_name, true FROM drafts, unnest(range(ranges)) WHERE contains(p_name, ' ')""",
    "advisory_audit": f"""WITH deps AS (SELECT 'mod/' || l_partkey AS path, 'v' || CAST(l_quantity AS INT) || '.' || l_linenumber || '.0' ||
        CASE l_returnflag WHEN 'R' THEN '-rc1' WHEN 'N' THEN '+build' ELSE '' END AS version FROM lineitem),
      adv AS (SELECT 'adv' || p_partkey AS record_id, 'MAL-2024-' || p_partkey AS advisory_id, 'mod/' || p_partkey AS path,
        CASE WHEN p_size > 10 THEN p_size || '.2' END AS introduced, CASE WHEN p_size < 40 THEN (p_size + 10) || '.0.0' END AS fixed FROM part WHERE p_type <> 'SMALL' AND p_size <= 45),
      k AS (SELECT *, {_ver('version')} AS vk, CASE WHEN introduced IS NOT NULL THEN {_ver('introduced')} END AS lo, CASE WHEN fixed IS NOT NULL THEN {_ver('fixed')} END AS hi FROM deps JOIN adv USING (path))
      SELECT path, version, record_id, advisory_id, coalesce(introduced, '') AS introduced, coalesce(fixed, '') AS fixed FROM k
      WHERE (introduced IS NULL OR vk >= lo) AND (fixed IS NULL OR vk < hi)""",
    "staleness": f"""WITH cyc AS (SELECT ['go', 'nodejs', 'python'][n_nationkey % 3 + 1] AS product, CAST(n_nationkey // 3 AS VARCHAR) AS cycle,
        CASE n_regionkey WHEN 0 THEN '0001-01-01' WHEN 2 THEN '2023-01-01' END AS ended FROM nation WHERE n_regionkey IN (0, 2)),
      e AS (SELECT product, cycle, min(ended) AS ended FROM cyc GROUP BY ALL),
      r AS (SELECT 'r' || p_partkey AS id, 'p/' || p_partkey AS path, p_brand, CASE p_size % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'nodejs' WHEN 2 THEN 'python' END AS product, p_type,
        CASE WHEN p_size % 5 = 0 THEN CAST(p_size % 10 AS VARCHAR) WHEN p_size < 45 THEN (p_size % 10) || '.' || (p_size % 2) END AS cycle FROM part WHERE p_brand <> 'Brand#9')
      SELECT id, path, 'window_closed' AS signal, '2024-05-31' AS detail FROM r WHERE p_brand = 'Brand#3'
      UNION ALL SELECT id, path, 'runtime_ended', product || ' ' || cycle || ' ' || ended FROM r JOIN e USING (product, cycle) WHERE p_brand <> 'Brand#3' AND p_type <> 'SMALL'""",
    "prepare_drafts": f"""WITH {Q.CORPUS}, {CAND}, {Q.document_tokens("status IN ('validated', 'quarantined')")}, {Q.fp_ctes('queries', allowed="status IN ('validated', 'quarantined')")},
      {Q.bm25_ctes('queries', floor=25.0)}, lex AS (SELECT *, 'lexical' AS matched FROM top), {_tiers('lex')},
      nov AS (SELECT query_id AS draft_id, CASE WHEN bool_or(matched = 'fingerprint') THEN 'known' ELSE 'similar' END AS novelty FROM hitlist GROUP BY 1),
      src AS (SELECT draft_id AS id, text FROM cand), {findings_ctes('src')},
      fl AS (SELECT id AS draft_id, string_agg(category || ':' || rule, ',' ORDER BY category || ':' || rule) AS flags FROM found GROUP BY id),
      r AS (SELECT draft_id, id, title, concat_ws(',', CASE WHEN NOT length(title) BETWEEN 8 AND 120 THEN 'title_length' END,
        CASE WHEN {_BLANK('text')} THEN 'body_empty,symptom_summary,root_cause_required,fix_required' END) AS rules FROM cand)
      SELECT draft_id, coalesce(novelty, 'novel') AS novelty, CASE WHEN novelty = 'known' THEN 'known' WHEN rules <> '' THEN 'invalid' ELSE 'created' END AS outcome,
        rules, coalesce(flags, '') AS flags, 'experience/2024/' || substr(id, 5) || '-' || {_SLUG} || '.md' AS path FROM r LEFT JOIN nov USING (draft_id) LEFT JOIN fl USING (draft_id)""",
    "reports_to_counter_records": f"""WITH {_COUNTER} SELECT {Q.rid('event_id')} AS id, 'dead-end' AS kind, 'quarantined' AS status, title, target AS disputes,
      CASE WHEN evidence <> '' THEN evidence ELSE 'reported outcome: ' || outcome || '; no reproducible artifact provided (triage flag)' END AS why,
      'experience/2024/' || substr({Q.rid('event_id')}, 5) || '-' || {_SLUG} || '.md' AS path,
      length('## Outcome report' || chr(10) || chr(10) || 'A consuming agent reported that the lesson in **' || target || '** did not hold.' || chr(10) || chr(10) || '- **disputes:** ' || target
        || chr(10) || '- **outcome:** ' || outcome || chr(10) || chr(10) || '### Evidence' || chr(10) || chr(10) || CASE WHEN evidence <> '' THEN '```' || chr(10) || evidence || chr(10) || '```'
        ELSE '_No reproducible artifact provided — this is a triage flag, not execution-backed counter-evidence._' END) AS chars FROM rep2""",
    "dedup_drafts": f"""WITH {Q.CORPUS}, k AS (SELECT doc_id AS seq, status <> 'validated' AS creatable, CASE WHEN {_BLANK('body')} THEN title ELSE {Q.utrim('body')} END AS key FROM corpus),
      f AS (SELECT key, min(seq) AS first FROM k WHERE creatable GROUP BY key)
      SELECT seq, creatable, creatable AND seq = first AS accepted, sha256(key) AS key_hash FROM k LEFT JOIN f USING (key)""",
    "assign_ids": f"""WITH m AS (SELECT greatest((SELECT max(doc_id) FROM documents), (SELECT max(c_custkey) FROM customer), 321) AS m)
      SELECT o_orderkey AS seq, {Q.rid('m + row_number() OVER (ORDER BY o_orderkey)')} AS id FROM orders, m""",
    "integrity_check": f"""WITH r AS (SELECT {Q.rid("CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey END")} AS id, o_orderkey, o_custkey, o_orderstatus FROM orders),
      files AS (SELECT DISTINCT 'repro/' || l_orderkey AS path FROM lineitem), s AS (SELECT id, {Q.rid('o_orderkey + o_custkey')} AS target FROM r WHERE o_orderstatus = 'F'),
      dcl AS (SELECT id, 'repro/' || o_orderkey AS path FROM r WHERE o_orderstatus = 'O' UNION ALL SELECT id, 'repro/' || o_custkey FROM r)
      SELECT id, 'duplicate_id' AS problem, CAST(count(*) AS VARCHAR) AS detail FROM r GROUP BY id HAVING count(*) > 1
      UNION ALL SELECT id, 'dangling_superseded_by', target FROM s WHERE target NOT IN (SELECT id FROM r)
      UNION ALL SELECT id, 'missing_repro', path FROM dcl WHERE path NOT IN (SELECT path FROM files)""",
    "head_base_id_collision": f"""WITH r AS (SELECT {Q.rid('o_custkey')} AS id, 'e/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, o_orderstatus AS st FROM orders),
      b AS (SELECT id, min(path) AS lo, max(path) AS hi FROM r WHERE st = 'F' GROUP BY id), h AS (SELECT id, path FROM r WHERE st <> 'P'), f AS (SELECT id, min(path) AS first FROM h GROUP BY id)
      SELECT id, path, 'exists_on_base' AS problem, CASE WHEN lo <> path THEN lo ELSE hi END AS other FROM h JOIN b USING (id) WHERE lo <> path OR hi <> path
      UNION ALL SELECT id, path, 'introduced_twice', first FROM h JOIN f USING (id) WHERE path <> first""",
    "past_cycles": f"""WITH e AS (SELECT c_mktsegment AS product, CAST(c_custkey AS VARCHAR) AS cycle, c_acctbal AS b, '20' || lpad(CAST(CAST(floor(c_acctbal % 60) AS INT) AS VARCHAR), 2, '0') || '-02-03' AS dt FROM customer)
      SELECT product, cycle, CASE WHEN b > 8000 THEN '' ELSE dt END AS ended_on FROM e WHERE b > 8000 OR (b >= 2000 AND dt <= '{NOW}')""",
    "deprecated_packages": "SELECT p_name || '-' || p_partkey AS name, p_size || '.0' AS version FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_size <> 7",
    "changelog_breaking": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey, o_orderstatus AS st, o_totalprice AS tp, lower(o_orderpriority) AS subsystem,
        last_value(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders)
      SELECT doc, version, subsystem, 'drop f() of ' || o_orderkey AS subject, 'https://example.org/pr/' || o_orderkey AS url FROM o WHERE st <> 'F' AND tp > 250000 AND version IS NOT NULL""",
    "readme_gotchas": f"""WITH {Q.CORPUS}, g AS (SELECT id AS doc, {Q.utrim('title')} AS title, {Q.utrim('summary')} AS snippet, {Q.utrim("array_to_string(signatures, ' ')")} AS explanation FROM corpus)
      SELECT * FROM g WHERE title <> '' AND snippet <> '' AND explanation <> ''""",
    "background_text": "SELECT url AS path, length(html) + 1 AS chars FROM pages WHERE page_id % 10 <> 0",
}
