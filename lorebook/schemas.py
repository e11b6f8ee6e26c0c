"""Explicit schemas of every table the sources read (nothing is ever inferred)."""

from __future__ import annotations

RECORD = """
    schema_version INT, id STRING, kind STRING, status STRING, title STRING,
    symptom STRUCT<summary: STRING, error_signatures: ARRAY<STRING>,
        fingerprints: STRUCT<app: ARRAY<STRING>, generic: ARRAY<STRING>>>,
    applies_to ARRAY<STRUCT<ecosystem: STRING, package: STRING,
        versions: STRUCT<introduced: STRING, fixed: STRING>, runtime: MAP<STRING, STRING>>>,
    resolution STRUCT<root_cause: STRING, fix: STRING,
        dead_ends: ARRAY<STRUCT<tried: STRING, why_it_failed: STRING>>>,
    guard STRUCT<repro: STRING, repros: ARRAY<STRUCT<path: STRING, kind: STRING, label: STRING>>,
        guarding_test: STRING>,
    provenance STRUCT<
        source: STRUCT<author: STRING, session: STRING, pr: STRING>,
        recorded_at: STRING, validated_at: STRING,
        valid: STRUCT<`from`: STRING, until: STRING>,
        source_license: STRING, source_url: STRING,
        source_attribution: STRUCT<creator: STRING, title: STRING, license_url: STRING,
            changes: STRING, copyright_notice: STRING, notice: STRING, license_text: STRING>,
        rights_review: STRUCT<reviewer: STRING, reviewed_at: STRING, source_sha256: STRING,
            evidence_sha256: STRING, policy: STRING>,
        superseded_by: STRING, disputes: STRING,
        promotion: STRUCT<attested_at: STRING, reproduced_under: ARRAY<STRING>, judge_model: STRING,
            judge_decision: STRING, panel: ARRAY<STRUCT<judge_model: STRING, judge_decision: STRING>>>,
        demotion: STRUCT<attested_at: STRING, judge_model: STRING, judge_decision: STRING, report: STRING>,
        `usage`: STRUCT<retrieved: BIGINT, pushed: BIGINT, confirmed_helpful: BIGINT, last_hit: STRING>,
        security_flags: ARRAY<STRING>, consistency_flags: ARRAY<STRING>>,
    body STRING, path STRING
"""

OSV = """
    id STRING, aliases ARRAY<STRING>, summary STRING, details STRING, withdrawn STRING,
    affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>,
        ranges: ARRAY<STRUCT<events: ARRAY<STRUCT<introduced: STRING, fixed: STRING>>>>>>,
    references ARRAY<STRUCT<type: STRING, url: STRING>>
"""

EOL_CYCLE = "cycle STRING, eol STRING"

PACKAGE_META = "name STRING, version STRING, deprecated STRING"

DECISION = """
    ts STRING, channel STRING, query_hash STRING, query_text STRING, session STRING,
    tokens ARRAY<STRING>, fp_bypass BOOLEAN, idf_filtered INT,
    served ARRAY<STRUCT<id: STRING, score: DOUBLE>>, count INT, trigger STRING
"""

OUTCOME = """
    ts STRING, exposure_id STRING, session_hash STRING, record_id STRING,
    used BOOLEAN, confirmed BOOLEAN, incorrect BOOLEAN
"""

COHORT = "team STRING, session_hash STRING"

QUEUES = {
    "report": """record_id STRING, outcome STRING, evidence STRING, author STRING,
        session STRING, reported_at STRING""",
    "transcript": """session_id STRING, author STRING, reason STRING, transcript STRING,
        captured_at STRING, source_url STRING, source_license STRING""",
    "issue": """title STRING, description STRING, category STRING, related_record_id STRING,
        author STRING, session STRING, reported_at STRING""",
    "draft": """kind STRING, title STRING, summary STRING, error_signatures ARRAY<STRING>,
        ecosystem STRING, package STRING, root_cause STRING, fix STRING, guarding_test STRING,
        body STRING, author STRING, session STRING, reported_at STRING""",
}

RUN_MANIFEST = """
    run_id STRING, stage STRING, anomaly BOOLEAN, counts MAP<STRING, BIGINT>,
    judge_stats STRUCT<calls: BIGINT, approvals: BIGINT, rejections: BIGINT, p50_ms: BIGINT, p95_ms: BIGINT>,
    actions ARRAY<STRUCT<id: STRING, outcome: STRING, from_status: STRING, to_status: STRING,
        judge_model: STRING, judge_decision: STRING, reproduced_under: ARRAY<STRING>,
        reason: STRING, advisory: BOOLEAN>>
"""

KINDS = ("trap", "fix", "dead-end", "convention", "workflow")
STATUSES = ("quarantined", "validated", "stale", "superseded", "disputed")
