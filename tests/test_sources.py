from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorebook.operators import gate as G
from lorebook.plans import tables as T
from lorebook.sources import corpus as C
from lorebook.sources import feeds, logs, sinks
from lorebook.streaming import jobs as J

RECORD = """---
schema_version: {version}
id: {id}
kind: trap
status: quarantined
title: "A trap that is long enough"
{extra}symptom:
  summary: it breaks
  error_signatures: ['boom at 0x1f', "CVE-2024-1"]
applies_to:
  - ecosystem: Go
    package: example.org/x
    versions: {{introduced: "1.0", fixed: null}}
    runtime: {{go: ">=1.20"}}
resolution:
  root_cause: because
  fix: do not
provenance:
  source: {{author: me, session: null, pr: null}}
  recorded_at: 2024-05-06
  validated_at: null
  valid: {{from: "2024-05-06", until: null}}
  superseded_by: {superseded}
---
Body text.
"""


def put(root, name, **kw):
    path = root / "experience" / "2024" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    values = {"version": 1, "id": "exp-" + name[:4], "extra": "", "superseded": "null", **kw}
    path.write_text(values.pop("text", None) or RECORD.format(**values))


def test_read_corpus_modes(spark, tmp_path):
    put(tmp_path, "0001-good.md")
    put(tmp_path, "0002-extra.md", extra="surprise: 1\n")
    put(tmp_path, "0003-future.md", version=2)
    put(tmp_path, "0004-nofence.md", text="no fence")
    put(tmp_path, "0005-badyaml.md", text="---\na: [\n---\nbody\n")
    put(tmp_path, "0001-zcopy.md", id="exp-0001")
    put(tmp_path, "0006-dangling.md", superseded="exp-9999")
    put(tmp_path, "notes.md", text="ignored")
    seen = {}
    for mode in ("strict", "resilient", "serve"):
        records, rejects = C.read_corpus(spark, str(tmp_path), mode, now="2024-06-01")
        seen[mode] = (sorted(r["id"] for r in records.select("id").collect()), {r["path"][16:]: r for r in rejects.collect()})
    assert seen["strict"][0] == ["exp-0001"]
    assert seen["resilient"][0] == ["exp-0001", "exp-0006"]
    assert seen["serve"][0] == ["exp-0001", "exp-0002", "exp-0006"]
    rejects = seen["resilient"][1]
    assert rejects["0003-future.md"]["critical"] and not rejects["0004-nofence.md"]["critical"]
    assert "duplicate id" in rejects["0001-zcopy.md"]["reason"] and "surprise" in rejects["0002-extra.md"]["reason"]
    row = C.read_corpus(spark, str(tmp_path), "serve", now="2024-06-01")[0].where("id = 'exp-0001'").first()
    assert row["applies_to"][0]["runtime"] == {"go": ">=1.20"} and row["applies_to"][0]["versions"]["fixed"] is None
    assert row["provenance"]["recorded_at"] == "2024-05-06" and row["body"] == "Body text."


def test_write_records_and_flush_usage(spark, sf, tmp_path):
    old = T.records(spark, sf)
    usage = spark.createDataFrame([("exp-0001", 1, 2, 0, None), ("exp-9999", 1, 1, 1, None)], "record_id string, retrieved bigint, pushed bigint, confirmed_helpful bigint, last_hit string")
    changed = C.flush_usage(old, usage)
    assert [r["id"] for r in changed.select("id").collect()] == ["exp-0001"]
    assert C.flush_usage(changed, usage).isEmpty()
    assert C.write_records(changed, old, str(tmp_path / "snap")) == 1
    assert spark.read.parquet(str(tmp_path / "snap")).count() == old.count()


def test_logs(spark, tmp_path):
    h = "a" * 32
    row = {"ts": "2024-01-01T00:00:00Z", "channel": "push", "query_hash": h, "served": [{"id": "exp-0001", "score": 1.5}], "count": 1, "trigger": "prompt"}
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(row) for _ in range(2)))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(row) for _ in range(3)))
    (tmp_path / "bad.jsonl").write_text(json.dumps({**row, "query_text": "x"}))
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    assert logs.read_decisions(spark, paths).count() == 5
    assert logs.read_decisions(spark, paths, "overlap-snapshot").count() == 3
    with pytest.raises(Exception, match="query_text_forbidden"):
        logs.read_decisions(spark, [str(tmp_path / "bad.jsonl")]).collect()
    (tmp_path / "o.jsonl").write_text(json.dumps({"ts": row["ts"], "session_hash": h, "record_id": "exp-0001", "used": True}))
    assert logs.read_outcomes(spark, str(tmp_path / "o.jsonl")).count() == 1
    (tmp_path / "o2.jsonl").write_text(json.dumps({"ts": row["ts"], "session_hash": h, "record_id": "exp-0001", "confirmed": True}))
    with pytest.raises(Exception, match="confirmed_without_use"):
        logs.read_outcomes(spark, str(tmp_path / "o2.jsonl")).collect()
    (tmp_path / "c.csv").write_text(f"team,session_hash\ncore,{h}\n")
    assert logs.read_cohorts(spark, str(tmp_path / "c.csv")).count() == 1
    (tmp_path / "c2.csv").write_text(f"team,session_hash\ncore,{h}\nedge,{h}\n")
    with pytest.raises(ValueError):
        logs.read_cohorts(spark, str(tmp_path / "c2.csv"))
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "r.json").write_text(json.dumps({"run_id": "r1", "stage": "promote", "anomaly": False, "counts": {"held": 1}, "actions": [{"id": "exp-0001", "outcome": "held"}]}, indent=2))
    assert logs.read_run_manifests(spark, str(tmp_path / "run")).first()["outcome"] == "held"


def test_feeds(spark, tmp_path):
    (tmp_path / "osv").mkdir()
    adv = lambda i, eco, **kw: {"id": i, "affected": [{"package": {"ecosystem": eco, "name": "p"}, "ranges": []}], **kw}
    for n, a in enumerate([adv("A", "Go"), adv("B", "npm"), adv("C", "Go", withdrawn="2024"), adv("", "Go"), adv("D", "Go:v1")]):
        (tmp_path / "osv" / f"{n}.json").write_text(json.dumps(a))
    assert sorted(r["id"] for r in feeds.read_osv(spark, str(tmp_path / "osv"), "Go").collect()) == ["A", "D"]
    (tmp_path / "eol").mkdir()
    (tmp_path / "eol" / "go.json").write_text(json.dumps([{"cycle": "1.19", "eol": "2023-09-06"}, {"cycle": "1.22", "eol": False}, {"cycle": "1.1", "eol": True}, {"cycle": "9", "eol": "bad"}]))
    got = feeds.read_eol_cycles(spark, str(tmp_path / "eol"), "2024-01-01").collect()
    assert sorted((r["product"], r["cycle"]) for r in got) == [("go", "1.1"), ("go", "1.19")]
    (tmp_path / "npm").mkdir()
    for n, dep in enumerate(["old", True, False, "", None]):
        (tmp_path / "npm" / f"{n}.json").write_text(json.dumps({"name": f"p{n}", "version": "1", "deprecated": dep}))
    assert sorted(r["name"] for r in feeds.read_package_deprecations(spark, str(tmp_path / "npm")).collect()) == ["p0", "p1"]
    (tmp_path / "cl.md").write_text("* **(SEMVER-MAJOR)** **x**: early (A) [#1](u)\n## 2024-01-01, Version 1.2.3 'N'\n* - **(SEMVER-MAJOR)** **http2**: remove f() now (Some One) [#5](https://u/5)\n* **(SEMVER-MAJOR)** broken\n")
    rows = feeds.changelog_breaking(spark, str(tmp_path / "cl.md")).collect()
    assert [(r["version"], r["subsystem"], r["subject"], r["url"]) for r in rows] == [("1.2.3", "http2", "remove f() now", "https://u/5")]
    (tmp_path / "rd.md").write_text("## Early\n# 👀 Examples\n## One\n```js\n1+1\n```\n### 💡 Explanation:\nwhy\n## Two\nno code\n# Contributing\n## Late\n")
    assert [(r["title"], r["snippet"], r["explanation"]) for r in feeds.readme_gotchas(spark, str(tmp_path / "rd.md")).collect()] == [("One", "1+1", "why")]


def test_background_corpus_and_idf_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("cat cat cat Dog --- !")
    (src / "b.txt").write_text("dog bird")
    (src / "c.bin").write_bytes(b"cat\x00dog")
    manifest = spark.createDataFrame([("s", str(src), "MIT")], "name string, path string, license string")
    docs = feeds.read_background_corpus(spark, manifest)
    idf = G.build_idf(docs)
    assert {r["word"]: r["df"] for r in idf.collect()} == {"cat": 1, "dog": 2, "bird": 1}
    sinks.write_idf(idf, docs.count(), str(tmp_path / "idf"))
    table, total = sinks.read_idf(spark, str(tmp_path / "idf"))
    assert total == 2 and {r["word"]: r["df"] for r in table.collect()} == {"cat": 1, "dog": 2, "bird": 1}
    with pytest.raises(ValueError):
        feeds.read_background_corpus(spark, manifest.withColumn("license", F.lit("GPL-3.0")))


def test_pack_manifest_and_pilot_csv(spark, sf, tmp_path):
    included, excluded, _ = sinks.pack_manifest(T.records(spark, sf), str(tmp_path / "pack"), commercial=False)
    assert included.count() + excluded.count() == T.records(spark, sf).count()
    from lorebook.plans import logs as LP

    rep = LP.M.pilot_metrics(LP.decisions(spark, sf), LP.outcomes(spark, sf), LP.cohorts(spark, sf), LP.BASELINE, LP.TREATMENT)
    sinks.write_pilot_csv(rep, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert len(back.columns) == 31 and back.where("scope = 'aggregate'").count() == 2


def test_pilot_rates_round_exact_binary_values(spark):
    rates = [1 / 128, 3 / 128, 0.1234565, 0.0, 1.0, None]
    report = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, r double").select(
        *[F.lit("x").alias(c) for c in ("scope", "arm", "team", "record_id")], *[F.col("i").alias(c) for c in sinks.PILOT_COUNTS],
        *[F.col("r").alias(c) for c in sinks.PILOT_RATES],
    )
    got = {r[sinks.PILOT_COUNTS[0]]: r[sinks.PILOT_RATES[0]] for r in sinks.pilot_rows(report).collect()}
    assert got == {str(i): "" if r is None else "%.6f" % r for i, r in enumerate(rates)}


def test_queue_drain_dead_letters(spark, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    for n in range(6):
        (queue / f"{n}.json").write_text(json.dumps({"session_id": f"s{n}", "transcript": "bad" if n < 2 else "fine", "captured_at": "t"}))
    (queue / "8.json").write_text(json.dumps({"session_id": "s8", "transcript": "  ", "captured_at": "t"}))
    (queue / "9.json").write_text("{not json")

    def analyze(df):
        return df.select("file_name", F.when(F.col("transcript") == "bad", "unprocessable").otherwise("").alias("error"), F.col("transcript").alias("title"))

    q = J.stream_queue_drain(spark, str(queue), str(tmp_path / "ck"), str(tmp_path / "out"), analyze, lambda df: df, batch_key=["title"])
    q.awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert [(r["file_name"], r["title"]) for r in read("processed").collect()] == [("2.json", "fine")]
    assert sorted((r["file_name"], r["reason"]) for r in read("dead").collect()) == [("0.json", "unprocessable"), ("1.json", "unprocessable")]
    assert sorted((r["file_name"], r["reason"]) for r in read("queued").collect()) == [("8.json", "blank"), ("9.json", "unreadable")]
    alert = read("alerts").first()
    assert (alert["failed"], alert["attempted"], alert["alert"]) == (2, 6, True)


def test_counters_over_many_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J._write_batches, "__defaults__", ((), 3))
    schema = "record_id string, action string, day date"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n in range(8):
        rows = [(f"r{n % 3}", "retrieve", datetime(2024, 1, 1 + n).date()), ("r0", "push", datetime(2024, 1, 1).date())]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.stream_usage_counters(stream, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    assert len(list((tmp_path / "out" / "data").glob("*-*"))) <= 8 and len(list((tmp_path / "out").glob("manifest-*"))) == 3
    got = {r["record_id"]: (r["retrieved"], r["pushed"]) for r in J.latest(spark, str(tmp_path / "out"), ["record_id"]).collect()}
    assert got == {"r0": (3, 8), "r1": (3, 0), "r2": (2, 0)}


def test_alarm_cooldown_against_loop(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("c", start + timedelta(hours=h), h in (9,)) for h in range(0, 24)]
    spark.createDataFrame(rows, "condition string, ts timestamp, healthy boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("condition string, ts timestamp, healthy boolean").parquet(str(tmp_path / "in"))
    J.stream_alarm_cooldown(stream, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    fired = sorted((r["ts"] - start).total_seconds() / 3600 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert fired == [0, 6, 10, 16, 22]
