"""Structured Streaming twins of the event-driven jobs.

Every job takes a source folder, a checkpoint folder and a sink folder and returns its
StreamingQuery.  Sinks of events are written per micro-batch into ``batch=<id>`` folders with
overwrite, so a replayed batch replaces itself; sinks of counters are keyed tables with versions,
of which :func:`latest` reads the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import text as X
from ..functions.ranking import bucketed_row_number, range_offsets, sorted_places
from ..functions.stats import count_if
from ..schemas import QUEUES
from ..session import cut_lineage
from ..sources.logs import parse_decisions, read_queue
from .keyed import KeyedTable

# Quota state lifetime, alarm cooldown, analysis attempts and alert share.
STATE_DAYS = 2
COOLDOWN_SECONDS = 6 * 3600
ATTEMPTS = 3
MIN_SAMPLE, ALERT_SHARE = 5, 0.20

# Micro-batches after which a sink of newest rows is compacted.
COMPACT_EVERY = 20

CALLS = "call_id BIGINT, token_id BIGINT, tool STRING, ts TIMESTAMP"


def _write_batches(
    df: DataFrame, checkpoint: str, sink: str, mode: str, trigger: dict | None, keys: Sequence[str] = (), every: int = COMPACT_EVERY
) -> StreamingQuery:
    """With ``keys``, the sink is a :class:`.keyed.KeyedTable`, merged every so many batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if keys:
            KeyedTable(batch.sparkSession, sink, tuple(keys), every).upsert(batch, batch_id)
        else:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )


def latest(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a keyed sink, pinned to the version it has now."""
    rows = KeyedTable(spark, sink, tuple(keys)).snapshot()
    if rows is None:
        raise ValueError(f"no batch has been written to {sink}")
    return rows


def stream_decisions(spark: SparkSession, source: str, checkpoint: str, sink: str, trigger: dict | None = None) -> StreamingQuery:
    """Raw JSON lines -> ``<sink>/valid`` and ``<sink>/rejects`` (with the broken rule)."""
    lines = spark.readStream.text(source).select(F.col("_metadata.file_path").alias("file"), "value")

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_decisions(batch)
        ok = F.col("problem").isNull()
        parsed.where(ok).drop("problem", "raw", "file").write.mode("overwrite").parquet(f"{sink}/valid/batch={batch_id}")
        parsed.where(~ok).select("file", "raw", "problem").write.mode("overwrite").parquet(f"{sink}/rejects/batch={batch_id}")

    return (
        lines.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write).start()
    )


def stream_usage_counters(events: DataFrame, checkpoint: str, sink: str, trigger: dict | None = None) -> StreamingQuery:
    """Running usage per record from a stream of (record_id, action, day); state is one row per record."""
    action = F.col("action")
    counts = events.where(action.isin("retrieve", "push", "confirm")).groupBy("record_id").agg(
        count_if(action == "retrieve").alias("retrieved"),
        count_if(action == "push").alias("pushed"),
        count_if(action == "confirm").alias("confirmed_helpful"),
        F.max(F.when(action == "retrieve", F.col("day"))).alias("last_hit"),
    )
    return _write_batches(counts, checkpoint, sink, "update", trigger, ["record_id"])


def stream_tenant_calls(calls: DataFrame, checkpoint: str, sink: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls per token, UTC day and tool; a day closes one day late."""
    day = F.window("ts", "1 day")
    counts = calls.withWatermark("ts", "1 day").groupBy("token_id", "tool", day).agg(F.count("*").alias("calls"))
    out = counts.select("token_id", "tool", F.col("window.start").cast("date").alias("day"), "calls")
    return _write_batches(out, checkpoint, sink, "update", trigger, ["token_id", "tool", "day"])


def stream_digest(decisions: DataFrame, checkpoint: str, sink: str, trigger: dict | None = None) -> StreamingQuery:
    """Trailing 24 hour counts by channel and trigger, every hour; ``decisions`` has (ts, channel, trigger, count)."""
    hit = F.coalesce("count", F.lit(0)) > 0
    sums = (
        decisions.withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", "24 hours", "1 hour"), "channel", F.coalesce("trigger", F.lit("")).alias("trigger"))
        .agg(F.count("*").alias("queries"), count_if(hit).alias("served"))
    )
    out = sums.select(F.col("window.end").alias("until"), "channel", "trigger", "queries", "served")
    return _write_batches(out, checkpoint, sink, "update", trigger, ["until", "channel", "trigger"])


def stream_quota(calls: DataFrame, quotas: DataFrame, checkpoint: str, sink: str, trigger: dict | None = None) -> StreamingQuery:
    """Answer every call (call_id, token_id, ts) of a stream by ``quotas`` (token_id, daily_quota).

    ``sink`` gets (token_id, day, call_id, admitted, reason) as :func:`answered_calls` defines them.  Below
    ``<sink>/_used`` stand the admitted calls of each limited token and UTC day, below ``<sink>/_seen`` the
    newest time of all batches; a batch that is replayed starts from what the batches before it have left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters, clock = KeyedTable(spark, f"{sink}/_used", ("token_id", "day")), KeyedTable(spark, f"{sink}/_seen", ("name",))
        seen, used = clock.snapshot(batch_id), counters.snapshot(batch_id)
        newest = seen.first()["newest"] if seen is not None else None
        if used is None:
            used = spark.createDataFrame([], "token_id bigint, day string, calls bigint")
        answers = cut_lineage(answered_calls(batch, quotas, used, newest))
        answers.select("token_id", "day", "call_id", "admitted", "reason").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        latest = answers.agg(F.max(F.unix_micros("ts"))).first()[0]
        newest = max((t for t in (newest, latest) if t is not None), default=None)
        clock.upsert(spark.createDataFrame([("calls", newest)], "name string, newest bigint"), batch_id)
        more = answers.where("admitted AND daily_quota > 0").groupBy("token_id", "day").agg(F.count("*").alias("more"))
        after = more.join(used, ["token_id", "day"], "left").select("token_id", "day", (F.col("more") + F.coalesce("calls", F.lit(0))).alias("calls"))
        counters.upsert(after, batch_id, alive=~_day_closed(newest))

    return (
        calls.select("call_id", "token_id", "ts").writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )


def _day_closed(newest: int | None) -> Column:
    """Whether ``day`` ended ``STATE_DAYS`` days or more before the newest time seen, in microseconds."""
    end = F.unix_micros(F.to_timestamp("day", "yyyy-MM-dd")) + (1 + STATE_DAYS) * 86_400_000_000
    return F.coalesce(end <= F.lit(newest).cast("bigint"), F.lit(False))


def answered_calls(calls: DataFrame, quotas: DataFrame, used: DataFrame, newest: int | None) -> DataFrame:
    """(token_id, day, call_id, ts, daily_quota, admitted, reason): one answer for each call of a batch.

    Calls of a token and UTC day are admitted by time, then call_id, while fewer than its quota are; ``used``
    (token_id, day, calls) holds what earlier batches have admitted.  A quota of zero or less is
    unlimited.  ``reason`` is null for an admitted call, else quota; late, if the day had closed by the
    newest time of earlier batches; time, if ``ts`` is null; unknown, for a token without a quota.
    Calls are ranked inside minutes, so that a hot token is many small groups.
    """
    named = calls.join(quotas.select("token_id", "daily_quota"), "token_id", "left").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    refused = (
        F.when(F.col("ts").isNull(), "time").when(_day_closed(newest), "late").when(F.col("daily_quota").isNull(), "unknown")
    )
    rows = cut_lineage(named.withColumn("refused", refused))
    limited = F.col("refused").isNull() & (F.col("daily_quota") > 0)
    ranked = bucketed_row_number(rows.where(limited), ["token_id", "day"], ["ts", "call_id"], F.date_trunc("minute", "ts"), "place")
    free = F.col("place") <= F.col("daily_quota") - F.coalesce("calls", F.lit(0))
    judged = ranked.join(used.select("token_id", "day", "calls"), ["token_id", "day"], "left").withColumn("admitted", free)
    rest = rows.where(~limited).withColumn("admitted", F.col("refused").isNull())
    columns = ["token_id", "day", "call_id", "ts", "daily_quota", "refused", "admitted"]
    both = judged.select(*columns).union(rest.select(*columns))
    return both.withColumn("reason", F.when(~F.col("admitted"), F.coalesce("refused", F.lit("quota")))).drop("refused")


def stream_alarm_cooldown(
    conditions: DataFrame, checkpoint: str, sink: str, cooldown: int = COOLDOWN_SECONDS, trigger: dict | None = None
) -> StreamingQuery:
    """Alarms of (condition, ts, healthy) readings: at most one per cooldown, reset when healthy.

    ``sink`` gets (condition, ts) of the alarms; below ``<sink>/_status`` stands what each batch has left
    behind (condition, healthy, last), which :func:`stream_alarm_reminders` reads.  Readings of one
    time count in the order of their arrival.  A batch that is replayed starts from the state before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = KeyedTable(spark, f"{sink}/_state", ("condition",))
        before = table.snapshot(batch_id)
        if before is None:
            before = spark.createDataFrame([], "condition string, last timestamp")
        fired, after = cooled_alarms(batch, before, cooldown)
        fired.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{sink}/_status/batch={batch_id}")
        table.upsert(after.select("condition", "last"), batch_id)

    return (
        conditions.select("condition", "ts", "healthy").writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )


def cooled_alarms(readings: DataFrame, before: DataFrame, cooldown: int) -> tuple[DataFrame, DataFrame]:
    """((condition, ts) of alarms, (condition, healthy, last) after them) of readings (condition, ts, healthy).

    ``before`` (condition, last) holds the alarm that a condition carries over, if any.  A healthy reading
    ends a run, and runs of unhealthy readings don't depend on each other, but for the first one, which
    continues what is carried over.  So readings are numbered by a range-partitioned sort, healthy ones are
    counted as running sums, and every run is walked apart as a sorted stream that holds one time.
    """
    numbered = readings.where(F.col("condition").isNotNull() & F.col("ts").isNotNull()).withColumn("n", F.monotonically_increasing_id())
    healthy = F.coalesce("healthy", F.lit(False))
    placed = sorted_places(numbered.select(F.struct("condition", "ts", "n", healthy.alias("healthy")).alias("o")), "o")
    resets = F.col("o.healthy").cast("bigint")
    offsets = range_offsets(placed, {"before": F.sum(resets)})
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(resets).over(upto) + F.col("before")
    rows = cut_lineage(placed.join(F.broadcast(offsets), "_part").select("o.*", run.alias("run")))
    # The first run of a condition has no healthy reading of its own before it.
    ends = rows.groupBy("condition").agg(
        F.min(F.struct("ts", "n", "healthy", "run"))["run"].alias("run0"), F.min(F.struct("ts", "n", "healthy"))["healthy"].alias("starts_healthy"),
        F.max(F.struct("ts", "n", "healthy"))["healthy"].alias("healthy"), F.max("run").alias("run1"),
    )
    ends = cut_lineage(ends.join(before.select("condition", F.col("last").alias("carried")), "condition", "left"))
    carried = ends.where("NOT starts_healthy AND carried IS NOT NULL").select("condition", F.col("run0").alias("run"), F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("n"), "carried")
    each = rows.where("NOT healthy").select("condition", "run", "ts", "n", F.lit(None).cast("timestamp").alias("carried")).union(carried)
    fired = cut_lineage(
        each.repartition("condition", "run").sortWithinPartitions("condition", "run", F.col("ts").asc_nulls_first(), "n")
        .mapInArrow(_walk(cooldown), "condition string, run bigint, ts timestamp")
    )
    newest = fired.groupBy("condition", "run").agg(F.max("ts").alias("newest"))
    left = ends.join(newest.withColumnRenamed("run", "run1"), ["condition", "run1"], "left")
    goes_on = (F.col("run1") == F.col("run0")) & ~F.col("starts_healthy")
    last = F.when(~F.col("healthy"), F.coalesce("newest", F.when(goes_on, F.col("carried"))))
    return fired.select("condition", "ts"), left.select("condition", "healthy", last.alias("last"))


def _walk(cooldown: int):
    def walk(batches):
        import pyarrow as pa

        key, last = None, None
        for b in batches:
            at = []
            names, runs = b.column(0).to_pylist(), b.column(1).to_pylist()
            times, carried = (b.column(c).cast(pa.int64()).to_pylist() for c in (2, 4))
            for i, now in enumerate(zip(names, runs, strict=True)):
                if now != key:
                    key, last = now, None
                if carried[i] is not None:
                    last = carried[i]
                elif last is None or times[i] - last >= cooldown * 1_000_000:
                    last = times[i]
                    at.append(i)
            some = pa.array(at, pa.int64())
            yield pa.record_batch([b.column(c).take(some) for c in range(3)], ["condition", "run", "ts"])

    return walk


class _Reminder(StatefulProcessor):
    """Reminds of an alarm each time the cooldown has passed, without input, until it is cleared."""

    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown_ms = cooldown_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "batch BIGINT, last TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        newest = max(((int(r.batch), None if pd.isna(r.last) else r.last) for pdf in rows for r in pdf.itertuples()), key=lambda r: r[0])
        if self.alarm.exists() and self.alarm.get()[0] >= newest[0]:
            return
        for at in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(at)
        if newest[1] is None:
            self.alarm.clear()
        else:
            self.alarm.update(newest)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cooldown_ms)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.cooldown_ms)
        yield pd.DataFrame({"condition": [key[0]], "since": [self.alarm.get()[1]], "due": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def stream_alarm_reminders(
    spark: SparkSession, status: str, checkpoint: str, sink: str, cooldown: float = COOLDOWN_SECONDS, trigger: dict | None = None
) -> StreamingQuery:
    """(condition, since, due): a reminder of every alarm that stands, each time the cooldown has passed.

    ``status`` is the ``_status`` folder of :func:`stream_alarm_cooldown`: one row per condition and batch.
    Timers run on processing time, so a reminder needs no reading; a newer alarm starts the cooldown
    anew and a healthy reading ends it.  The session needs the RocksDB state store.
    """
    rows = spark.readStream.schema("condition STRING, healthy BOOLEAN, last TIMESTAMP, batch BIGINT").parquet(status)
    out = rows.groupBy("condition").transformWithStateInPandas(
        _Reminder(int(cooldown * 1000)), "condition STRING, since TIMESTAMP, due TIMESTAMP", "append", "ProcessingTime"
    )
    return _write_batches(out, checkpoint, sink, "append", trigger or {"processingTime": "30 seconds"})


def stream_session_attribution(
    verdicts: DataFrame, served: DataFrame, checkpoint: str, sink: str, within: str = "1 day", trigger: dict | None = None
) -> StreamingQuery:
    """Used verdicts joined to what their session was served at most ``within`` before.

    Both streams are (session, record_id, ts); either side may be late by the same bound.  ``sink`` gets
    (session, record_id, v_ts, served): a pair of session and record is confirmed once, however often it was
    served or judged, unless it comes again after the watermark has passed it by ``within``.  A verdict for
    which nothing was served comes with ``served`` false when the watermark rules a match out; a null session
    or record matches nothing.
    """
    v = verdicts.where("used").select(F.col("session").alias("v_session"), F.col("record_id").alias("v_record"), F.col("ts").alias("v_ts"))
    v, s = v.withWatermark("v_ts", within), served.select("session", "record_id", "ts").withWatermark("ts", within)
    near = (F.col("v_ts") >= F.col("ts")) & (F.col("v_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    joined = v.join(s, (F.col("v_session") == F.col("session")) & (F.col("v_record") == F.col("record_id")) & near, "left_outer")
    found = joined.select(F.col("v_session").alias("session"), F.col("v_record").alias("record_id"), "v_ts", F.col("ts").isNotNull().alias("served"))
    once = found.dropDuplicatesWithinWatermark(["session", "record_id", "served"])
    return _write_batches(once, checkpoint, sink, "append", trigger)


def stream_queue_drain(
    spark: SparkSession,
    source: str,
    checkpoint: str,
    sink: str,
    analyze: Callable[[DataFrame], DataFrame],
    process: Callable[[DataFrame], DataFrame],
    kind: str = "transcript",
    trigger: dict | None = None,
    batch_key: Sequence[str] = (),
) -> StreamingQuery:
    """Drain queue files once: ``<sink>/processed``, ``<sink>/dead``, ``<sink>/queued`` and ``<sink>/alerts``.

    ``analyze`` turns entries into (file_name, error, <candidate columns>), one or more rows per
    file with an error text when unprocessable; a file is tried three times and then
    dead-lettered.  Of equal candidates (by ``batch_key``) of a batch, that of the first file is
    kept; ``process`` turns these into output rows.  Unreadable and blank entries are not
    tried and stay queued.  A batch alerts when more than 20% of at least five entries fail.
    """
    assert kind in QUEUES
    entries = read_queue(spark, source, kind, streaming=True)

    def drain(batch: DataFrame, batch_id: int) -> None:
        at = lambda name: f"{sink}/{name}/batch={batch_id}"
        usable = F.col("readable") & (~X.is_blank("transcript") if kind == "transcript" else F.lit(True))
        usable = F.coalesce(usable, F.lit(False))
        todo = batch.where(usable)
        good = None
        for attempt in range(ATTEMPTS):
            # Durable between attempts: a later attempt must not re-run an earlier one.
            path = at(f"attempts/try={attempt}")
            analyze(todo).write.mode("overwrite").parquet(path)
            result = spark.read.parquet(path)
            failed = F.coalesce("error", F.lit("")) != ""
            done = result.where(~failed).drop("error")
            good = done if good is None else good.unionByName(done)
            todo = todo.join(result.where(failed).select("file_name").distinct(), "file_name", "left_semi")
            if todo.isEmpty():
                break
        if batch_key:
            rest = [c for c in good.columns if c not in batch_key]
            good = good.groupBy(*batch_key).agg(F.min_by(F.struct(*rest), F.col("file_name")).alias("r")).select(*batch_key, "r.*").select(*good.columns)
        process(good).write.mode("overwrite").parquet(at("processed"))
        todo.select("file_name", F.lit("unprocessable").alias("reason")).write.mode("overwrite").parquet(at("dead"))
        left = batch.where(~usable).select("file_name", F.when(F.col("readable"), "blank").otherwise("unreadable").alias("reason"))
        left.write.mode("overwrite").parquet(at("queued"))
        tried = batch.where(usable).agg(F.countDistinct("file_name").alias("attempted")).scalar()
        counts = spark.read.parquet(at("dead")).agg(count_if(F.col("reason") == "unprocessable").alias("failed"), tried.alias("attempted"))
        alert = (F.col("attempted") >= MIN_SAMPLE) & (F.col("failed") / F.col("attempted") > ALERT_SHARE)
        counts.withColumn("alert", alert).write.mode("overwrite").parquet(at("alerts"))

    return (
        entries.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(drain).start()
    )
