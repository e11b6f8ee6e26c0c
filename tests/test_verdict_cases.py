"""Literal cases that SQL twins can't catch, because a twin would share the misreading."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from test_sources import put

from lorebook.operators import advisories as A
from lorebook.operators import lifecycle as L
from lorebook.operators import rights as R
from lorebook.plans import tables as T
from lorebook.sources import corpus as C
from lorebook.sources import feeds, sinks


def test_one_action_per_disputed_record(spark):
    base = [("r1", "validated", None), ("r2", "validated", None), ("p1", "quarantined", "r1"), ("p2", "quarantined", "r1"), ("p3", "quarantined", "r1"), ("p0", "quarantined", "r1")]
    base += [(f"q{i}", "quarantined", "r2") for i in range(4)]
    records = spark.createDataFrame(base, "id string, status string, d string").select("id", "status", F.struct(F.col("d").alias("disputes")).alias("provenance"))
    evidence = [("p0", True, False, False, True), ("p1", False, False, False, False)] + [(i, True, False, False, False) for i in ("p2", "p3", "q0", "q1", "q2", "q3")]
    ev = spark.createDataFrame(evidence, "report_id string, original_holds boolean, original_inconclusive boolean, counter_holds boolean, counter_inconclusive boolean")
    out = {r.report_id: (r.action, r.reason, r.to_status) for r in L.adapt(records, ev, spark.createDataFrame([("p1", True)], "report_id string, approved boolean"), "2024-01-01").collect()}
    assert out["p0"] == ("none", "inconclusive", "validated")
    assert out["p1"] == ("demote", "reproduced", "stale")
    assert out["p2"] == out["p3"] == ("none", "not_validated", "stale")
    assert out["q0"] == ("dispute", "corroborated", "disputed")
    assert out["q1"] == out["q2"] == out["q3"] == ("none", "not_validated", "disputed")


def test_scalars_keep_their_written_text(spark, tmp_path):
    text = """---
schema_version: 1
id: exp-0001
kind: trap
status: quarantined
title: "A trap that is long enough"
symptom: {summary: 0123, error_signatures: [12:30:45, 'null']}
applies_to: [{ecosystem: npm, package: on, versions: {introduced: 1.10, fixed: ~}}]
resolution: {root_cause: yes, fix: 1e3}
provenance:
  source: {author: me}
  recorded_at: 2024-05-06
  valid: {from: 2024-05-06}
  rights_review: {reviewer: a, reviewed_at: 2026-07-01T00:00:00Z, policy: rights-v1}
---
Body text.
"""
    put(tmp_path, "0001-good.md", text=text)
    records, rejects = C.read_corpus(spark, str(tmp_path), "serve", now="2026-08-01")
    assert rejects.select("reason").collect() == []
    r = records.first()
    a = r.applies_to[0]
    assert (a.package, a.versions.introduced, a.versions.fixed) == ("on", "1.10", None)
    assert (r.symptom.summary, list(r.symptom.error_signatures)) == ("0123", ["12:30:45", "null"])
    assert (r.resolution.root_cause, r.resolution.fix) == ("yes", "1e3")
    assert r.provenance.rights_review.reviewed_at == "2026-07-01T00:00:00Z" and r.schema_version == 1


def test_a_frequency_table_of_many_parts(spark, tmp_path):
    words = [(f"w{i:05d}", i % 97 + 1) for i in range(5000)] + [("docs", 99), ("Docs", 3)]
    df = spark.createDataFrame(words, "word string, df bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_idf(df, 1234, str(tmp_path / "idf"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "idf").glob("part-*"))) > 2
    table, total = sinks.read_idf(spark, str(tmp_path / "idf"))
    assert total == 1234 and {r.word: r.df for r in table.collect()} == dict(words[:-2]) | {"docs": 99}


def test_several_ranges_are_one_scope_defect(spark):
    advisory, ecosystem, package, flag = A.SCOPE_DEFECTS[0]
    base = T.records(spark, "/root/testdata/sf0.001").limit(1)
    row = F.struct(F.lit(ecosystem).alias("ecosystem"), F.lit(package).alias("package"), F.struct(F.lit("1").alias("introduced"), F.lit("2").alias("fixed")).alias("versions"), F.lit(None).cast("map<string,string>").alias("runtime"))
    two = base.withColumn("applies_to", F.array(row, row)).withColumn("symptom", F.col("symptom").withField("error_signatures", F.array(F.lit(advisory))))
    flags = [r.flag for r in A.advisory_defects(two).collect()]
    assert flags.count(f"{flag}:{package}") == 1


def test_a_zero_count_alarms(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 5), ("a", datetime(2024, 1, 2), 0), ("b", t, 0), ("c", t, 4), ("c", datetime(2024, 1, 2), 6)]
    out = {r.corpus: r for r in L.growth_watch(spark.createDataFrame(rows, "corpus string, ts timestamp, validated bigint"), "2024-01-02 01:00:00", hours=48).collect()}
    assert (out["a"].alarm, out["a"].reason, out["a"].last_growth) == (True, "zero_count", t)
    assert (out["b"].alarm, out["b"].last_growth) == (True, None) and not out["c"].alarm


def test_feeds_keep_all_rows(spark, tmp_path):
    lines = "\n".join(f"- **(SEMVER-MAJOR)** **http**: change {i} (me) [#1](https://u/{i})" for i in range(321))
    (tmp_path / "cl.md").write_text(f"## 2020-01-02, Version 1.2.3 (Current)\n{lines}\n")
    assert feeds.changelog_breaking(spark, str(tmp_path / "cl.md")).count() == feeds.changelog_breaking(spark, str(tmp_path / "cl.md"), cap=400).count() > 300
    assert feeds.changelog_breaking(spark, str(tmp_path / "cl.md"), cap=200).count() == 200


def test_remediation_says_what_to_do(spark, sf):
    _, findings, queue = R.rights_audit(T.records(spark, sf))
    assert queue.where("action is null or automatic_change").count() == 0
    totals = R.rights_totals(findings).first()
    assert totals.total_records == findings.count() and totals.unresolved_evidence == queue.count()
