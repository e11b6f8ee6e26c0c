"""Keyed sinks with versions, alarms over many micro-batches, reminders on timers, exact order statistics."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from lorebook.functions.selection import nearest_ranks
from lorebook.sources import feeds, manifest
from lorebook.streaming import jobs as J
from lorebook.streaming.keyed import KeyedTable
from pyspark.sql import functions as F


def test_reader_keeps_its_version_and_a_replay_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ("k",), every=2, keep=2)
    assert table.snapshot() is None
    rows = lambda df: sorted(map(tuple, df.collect()))
    put = lambda pairs, n: table.upsert(spark.createDataFrame(pairs, "k string, v bigint"), n)
    put([("a", 1), ("b", 1)], 0)
    put([("a", 2)], 1)
    pinned = table.snapshot()
    put([("c", 3)], 2)  # merges: three parts are more than two
    assert len(manifest.load(spark, table.root, 3)["parts"]) == 1
    assert rows(pinned) == [("a", 2), ("b", 1)] and rows(table.snapshot()) == [("a", 2), ("b", 1), ("c", 3)]
    put([("a", 9)], 2)
    assert rows(table.snapshot()) == [("a", 2), ("b", 1), ("c", 3)]
    assert rows(table.snapshot(before=2)) == [("a", 2), ("b", 1)]
    put([("b", 4)], 3)
    put([("b", 5), (None, 6)], 4)
    assert sorted(map(str, table.snapshot().collect())) == sorted(map(str, spark.createDataFrame([("a", 2), ("b", 5), ("c", 3), (None, 6)], "k string, v bigint").collect()))
    assert len(manifest.versions(spark, table.root)) == 2
    # A batch that broke off before its manifest leaves a folder that no version names.
    (tmp_path / "t" / "data" / "batch-5-broken").mkdir()
    put([("d", 7)], 5)
    assert not (tmp_path / "t" / "data" / "batch-5-broken").exists()


def test_alarms_of_many_batches_against_loop(spark, tmp_path):
    rng = random.Random(7)
    start, rows = datetime(2024, 1, 1), []
    for c, n, well in (("hot", 300, 0.02), ("calm", 40, 0.9), ("ill", 60, 0.0), ("once", 1, 0.0)):
        for _ in range(n):
            rows.append((c, start + timedelta(seconds=rng.randrange(40 * 3600)), rng.random() < well))
    rows.sort(key=lambda r: r[1])
    rows += [(None, start, False), ("odd", start + timedelta(days=3), None)]
    want, last = [], {}
    for c, ts, healthy in rows:
        if c is None:
            continue
        if healthy:
            last[c] = None
        elif last.get(c) is None or (ts - last[c]).total_seconds() >= J.COOLDOWN_SECONDS:
            last[c] = ts
            want.append((c, ts))
    schema = "condition string, ts timestamp, healthy boolean"
    for i in range(4):  # one file a batch, in the order of time
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.stream_alarm_cooldown(stream, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    assert sorted((r["condition"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
    state = {r["condition"]: r["last"] for r in KeyedTable(spark, f"{tmp_path}/out/_state", ("condition",)).snapshot().collect()}
    assert state == last


def test_reminders_come_without_new_input(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    status = lambda rows, n: spark.createDataFrame(rows, "condition string, healthy boolean, last timestamp").coalesce(1).write.parquet(f"{tmp_path}/status/batch={n}")
    try:
        at = datetime(2024, 1, 1)
        status([("down", False, at), ("fine", True, None), ("mends", False, at)], 0)
        status([("mends", True, None)], 1)
        query = J.stream_alarm_reminders(spark, f"{tmp_path}/status", f"{tmp_path}/ck", f"{tmp_path}/out", 2.0, {"processingTime": "500 milliseconds"})
        rows, limit = [], time.time() + 90
        while len(rows) < 2 and time.time() < limit and query.isActive:
            time.sleep(1)
            rows = spark.read.schema("condition string, since timestamp, due timestamp").parquet(f"{tmp_path}/out").collect() if list((tmp_path / "out").glob("batch=*")) else []
        assert query.exception() is None
        query.stop()
    finally:
        spark.conf.set(key, before)
    assert len(rows) >= 2 and {(r["condition"], r["since"]) for r in rows} == {("down", at)}
    due = sorted(r["due"] for r in rows)
    assert (due[1] - due[0]).total_seconds() >= 2


def test_order_statistics_equal_percentile_disc(spark):
    rng = random.Random(8)
    rows = [("hot", rng.randrange(-(10**9), 10**9)) for _ in range(3000)] + [("ties", 5)] * 400 + [("ties", 6)] * 20
    rows += [(None, v) for v in (3, 1, 2)] + [("one", -7), ("gap", None), ("two", 1), ("two", 1 << 50)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = df.where("v IS NOT NULL").groupBy("g").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").cast("bigint").alias(k) for k, p in shares.items()])
    got = nearest_ranks(df, ["g"], "v", shares).select("g.g", *shares)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    whole = nearest_ranks(df, [], "v", shares).select(*shares).collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in df.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").cast("bigint") for p in shares.values()]).collect()]
    assert nearest_ranks(df.limit(0), ["g"], "v", shares).count() == 0


def test_every_call_is_answered_against_loop(spark, tmp_path):
    rng = random.Random(9)
    start, files, n = datetime(2024, 1, 1), [], 0
    for day in range(5):  # one delivery a day, with calls of up to five days before
        rows = []
        for _ in range(120):
            n += 1
            token = rng.choice([1, 1, 1, 1, 2, 3, 4, None])
            rows.append((n, token, start + timedelta(days=day - rng.choice([0, 0, 0, 1, 2, 4, 5]), seconds=rng.randrange(86400))))
        files.append(rows + [(10_000 + day, 1, None)])
    limits = {1: 9, 2: 2, 3: 0}
    want, used, newest = {}, {}, None
    for rows in files:
        for call, token, ts in sorted(rows, key=lambda r: (r[2] or datetime.max, r[0])):
            day = ts and ts.date()
            if ts is None:
                reason = "time"
            elif newest and datetime(day.year, day.month, day.day) + timedelta(days=1 + J.STATE_DAYS) <= newest:
                reason = "late"
            elif token not in limits:
                reason = "unknown"
            elif 0 < limits[token] <= used.get((token, day), 0):
                reason = "quota"
            else:
                reason = None
                used[token, day] = used.get((token, day), 0) + 1
            want[call] = reason
        newest = max([t for t in [newest, *(r[2] for r in rows)] if t])
    schema = "call_id bigint, token_id bigint, ts timestamp"
    quotas = spark.createDataFrame(list(limits.items()), "token_id bigint, daily_quota bigint")
    for rows in files:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        J.stream_quota(stream, quotas, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {r["call_id"]: r["reason"] for r in got} == want
    assert all(r["admitted"] == (r["reason"] is None) for r in got)
    assert set(want.values()) == {None, "time", "late", "unknown", "quota"}


def test_a_session_confirms_once_and_unserved_verdicts_come_apart(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    seen = "session bigint, record_id string, ts timestamp"
    served = [[(1, "a", t(0)), (1, "a", t(1)), (2, "b", t(1)), (None, "a", t(1))], [(1, "a", t(3)), (9, "z", t(300))]]
    verdicts = [[(1, "a", t(2), True), (1, "a", t(2), True), (2, "c", t(2), True), (2, "b", t(2), False)], [(1, "a", t(4), True), (None, "a", t(2), True), (9, "y", t(300), True)]]
    for s, v in zip(served, verdicts, strict=True):
        spark.createDataFrame(s, seen).write.mode("append").parquet(str(tmp_path / "served"))
        spark.createDataFrame(v, seen + ", used boolean").write.mode("append").parquet(str(tmp_path / "verdicts"))
        left, right = (spark.readStream.schema(seen + more).parquet(str(tmp_path / name)) for name, more in (("verdicts", ", used boolean"), ("served", "")))
        J.stream_session_attribution(left, right, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got = sorted(((r["session"], r["record_id"], r["served"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == [(1, "a", True), (2, "c", False), (None, "a", False)]


def test_changelogs_in_ranges_equal_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    for name, heads in (("long.md", 0.02), ("short.md", 0.3), ("none.md", 0.0)):
        lines = ["- **(SEMVER-MAJOR)** **early**: before any heading (Me) [#0](https://u/0)"]
        for i in range(1500):
            x = rng.random()
            end = rng.choice(["", "\r"])
            if x < heads:
                lines.append(f"## 2024-01-0{i % 9 + 1}, Version {i}.0.0 'é'{end}")
            elif x < 0.6:
                lines.append(f"* - **(SEMVER-MAJOR)** **part{i % 7}**: change {i} (Some One) [#{i}](https://u/{i}){end}")
            else:
                lines.append(rng.choice(["", "plain line", "* **(SEMVER-MAJOR)** broken"]) + end)
        (tmp_path / name).write_text("\n".join(lines), newline="")
    (tmp_path / "empty.md").write_text("")
    key, rows = "spark.sql.files.maxPartitionBytes", lambda df: sorted(map(tuple, df.collect()))
    texts = spark.read.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_name AS doc", "value AS text")
    want = rows(feeds.breaking_entries(texts))
    before = spark.conf.get(key)
    try:
        for size in ("1000", "4096", before):
            spark.conf.set(key, size)
            assert rows(feeds.changelog_breaking(spark, str(tmp_path))) == want
    finally:
        spark.conf.set(key, before)
    assert len(want) > 1000 and {r[0] for r in want} == {"long.md", "short.md"}
