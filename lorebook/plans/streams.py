"""Registered queries: streaming jobs replaying the events table, read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ensure_checkpoint_dir
from ..streaming import jobs as J
from . import logs as LP
from .tables import table

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _folders(spark: SparkSession) -> tuple[str, str]:
    """Checkpoint and sink folder of one run, in the shared checkpoint location."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/checkpoint", f"{base}/sink"


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_usage_counters(s, d):
    ck, sink = _folders(s)
    action = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "push").when(F.col("event_type") == "purchase", "confirm").otherwise("other")
    ev = _replay(s, d).select(X.record_id("k").alias("record_id"), action.alias("action"), F.col("ts").cast("date").alias("day"))
    _finish(J.stream_usage_counters(ev, ck, sink))
    return J.latest(s, sink, ["record_id"]).withColumn("last_hit", F.col("last_hit").cast("string"))


def stream_tenant_calls(s, d):
    ck, sink = _folders(s)
    calls = _replay(s, d).select(F.col("user_id").alias("token_id"), F.col("event_type").alias("tool"), "ts")
    _finish(J.stream_tenant_calls(calls, ck, sink))
    return J.latest(s, sink, ["token_id", "tool", "day"]).withColumn("day", F.col("day").cast("string"))


def stream_quota(s, d):
    """Two deliveries: every tenth call comes with the second one, when some days have closed."""
    ck, sink = _folders(s)
    source = sink.replace("/sink", "/calls")
    calls = table(s, d, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("token_id"), F.col("ts").cast("timestamp").alias("ts"))
    quotas = table(s, d, "customer").select(F.col("c_custkey").alias("token_id"), (F.col("c_nationkey") % 4).cast("bigint").alias("daily_quota"))
    second = F.col("call_id") % 10 == 0
    for part in (calls.where(~second), calls.where(second)):
        part.write.mode("append").parquet(source)
        _finish(J.stream_quota(s.readStream.schema(calls.schema).parquet(source), quotas, ck, sink))
    return s.read.parquet(sink).select("token_id", "day", "call_id", "admitted", "reason")


def stream_digest(s, d):
    ck, sink = _folders(s)
    e = _replay(s, d).where(F.col("event_type").isin("view", "click", "error"))
    dec = e.select(
        "ts", F.when(F.col("event_type") == "view", "search").otherwise("push").alias("channel"),
        F.when(F.col("event_type") == "click", "prompt").when(F.col("event_type") == "error", "error").alias("trigger"),
        (F.col("value") > 10).cast("int").alias("count"),
    )
    _finish(J.stream_digest(dec, ck, sink))
    return J.latest(s, sink, ["until", "channel", "trigger"]).withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


def stream_session_attribution(s, d):
    ck, sink = _folders(s)
    e = _replay(s, d)
    pair = [F.col("user_id").alias("session"), X.record_id("k").alias("record_id"), F.col("ts")]
    verdicts = e.where("event_type = 'purchase'").select(*pair, (F.col("value") > 5).alias("used"))
    served = e.where("event_type = 'view'").select(*pair)
    _finish(J.stream_session_attribution(verdicts, served, ck, sink))
    return s.read.parquet(sink).where("served").select("session", "record_id")


def stream_alarm_cooldown(s, d):
    ck, sink = _folders(s)
    e = _replay(s, d).select(F.col("event_type").alias("condition"), "ts", (F.col("value") < 1).alias("healthy"))
    _finish(J.stream_alarm_cooldown(e, ck, sink))
    return s.read.parquet(sink).select("condition", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def stream_decisions(s, d):
    ck, sink = _folders(s)
    source = sink.replace("/sink", "/lines")
    dec = LP.decisions(s, d)
    channel = F.when(F.col("event_id") % 7 == 0, "mail").otherwise(F.col("channel"))
    body = dec.withColumn("channel", channel).drop("event_id", "query_text")
    body.select(F.to_json(F.struct(*body.columns))).write.text(source)
    _finish(J.stream_decisions(s, source, ck, sink))
    valid = s.read.parquet(f"{sink}/valid").groupBy("channel").agg(F.count("*").alias("n")).withColumn("problem", F.lit(""))
    rejects = s.read.parquet(f"{sink}/rejects").groupBy("problem").agg(F.count("*").alias("n")).withColumn("channel", F.lit(""))
    return valid.unionByName(rejects)


QUERIES = {
    f.__name__: f
    for f in (
        stream_usage_counters, stream_tenant_calls, stream_quota, stream_digest, stream_session_attribution, stream_alarm_cooldown, stream_decisions,
    )
}

SQL = {
    "stream_alarm_cooldown": f"""WITH RECURSIVE r AS (SELECT event_type AS condition, ts, value < 1 AS healthy, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
      st AS (SELECT condition, n, ts, CASE WHEN NOT healthy THEN ts END AS last, NOT healthy AS fired FROM r WHERE n = 1
        UNION ALL SELECT condition, n, ts, CASE WHEN healthy THEN NULL WHEN due THEN ts ELSE last END, NOT healthy AND due
        FROM (SELECT r.*, st.last, st.last IS NULL OR epoch(r.ts) - epoch(st.last) >= {J.COOLDOWN_SECONDS} AS due FROM st JOIN r ON r.condition = st.condition AND r.n = st.n + 1))
      SELECT condition, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM st WHERE fired""",
    "stream_usage_counters": f"WITH {LP.USE} SELECT record_id, {LP._COUNTS} FROM use GROUP BY record_id",
    "stream_tenant_calls": LP.SQL["daily_calls"],
    "stream_quota": f"""WITH c AS (SELECT event_id AS call_id, user_id AS token_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id % 10 = 0 AS second FROM events),
      j AS (SELECT c.*, c_nationkey % 4 AS quota, CASE WHEN second AND (SELECT max(ts) FROM c WHERE NOT second) >= CAST(ts AS DATE) + INTERVAL {1 + J.STATE_DAYS} DAY THEN 'late' WHEN c_custkey IS NULL THEN 'unknown' END AS refused
        FROM c LEFT JOIN customer ON c_custkey = token_id),
      r AS (SELECT *, refused IS NULL AND (quota <= 0 OR row_number() OVER (PARTITION BY token_id, day, refused IS NULL ORDER BY second, ts, call_id) <= quota) AS admitted FROM j)
      SELECT token_id, day, call_id, admitted, CASE WHEN NOT admitted THEN coalesce(refused, 'quota') END AS reason FROM r""",
    "stream_digest": """WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'search' ELSE 'push' END AS channel, CASE event_type WHEN 'click' THEN 'prompt' WHEN 'error' THEN 'error' ELSE '' END AS trigger, value > 10 AS hit,
        unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS u FROM events WHERE event_type IN ('view', 'click', 'error'))
      SELECT strftime(u, '%Y-%m-%d %H:%M:%S') AS until, channel, trigger, count(*) AS queries, count(*) FILTER (hit) AS served FROM e GROUP BY ALL""",
    "stream_session_attribution": f"""WITH {LP.EV} SELECT DISTINCT v.user_id AS session, {LP.Q.rid('v.k')} AS record_id FROM ev v JOIN ev s ON v.user_id = s.user_id AND v.k = s.k AND v.event_type = 'purchase' AND s.event_type = 'view'
      WHERE v.value > 5 AND v.ts >= s.ts AND v.ts <= s.ts + INTERVAL 1 DAY""",
    "stream_decisions": f"""WITH {LP.DEC} SELECT CASE WHEN event_id % 7 = 0 THEN '' ELSE channel END AS channel, CASE WHEN event_id % 7 = 0 THEN 'channel' ELSE '' END AS problem, count(*) AS n FROM dec GROUP BY ALL""",
}
