"""Registered queries: usage, tenants, quotas, digests, measurement and log readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gate as G
from ..operators import measurement as M
from ..operators import telemetry as T
from ..sources import logs as L
from ..sources import sinks
from . import sqltext as Q
from .tables import corpus, table

NOW = "2024-01-30"
NOW_TS = "2024-01-30 12:00:00Z"
BASELINE = M.Window("2024-01-03T00:00:00Z", "2024-01-14T00:00:00Z")
TREATMENT = M.Window("2024-01-14T00:00:00Z", "2024-01-27T12:00:00Z")
SALT = "salt"
LIMITS = {"view": 2, "click": 1, "purchase": 3, "signup": 1}


def _events(s, d):
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _session():
    return X.salted_hash(SALT, F.col("user_id").cast("string"))


def usage_events(s, d):
    action = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "push").when(F.col("event_type") == "purchase", "confirm").otherwise("other")
    return _events(s, d).select(X.record_id("k").alias("record_id"), action.alias("action"), F.col("ts").cast("date").alias("day"))


def usage_counters(s, d):
    out = T.usage_counters(usage_events(s, d), totals=True)
    return out.select(F.coalesce("record_id", F.lit("TOTAL")).alias("record_id"), "retrieved", "pushed", "confirmed_helpful", F.col("last_hit").cast("string").alias("last_hit"))


def _titled(s, d):
    return corpus(s, d).select(F.col("id").alias("record_id"), "title", "status")


def record_usage(s, d):
    return T.record_usage(_titled(s, d), T.usage_counters(usage_events(s, d))).withColumn("last_hit", F.coalesce(F.col("last_hit").cast("string"), F.lit("")))


def top_records(s, d):
    return T.top_records(T.usage_counters(usage_events(s, d)), _titled(s, d), 10)


def status_counts(s, d):
    return T.status_counts(_titled(s, d))


def _tenants(s, d):
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("token_id"), F.col("c_name").alias("label"),
        F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("revoked_at"), F.col("c_nationkey").cast("bigint").alias("daily_quota"),
    )


def _calls(s, d):
    return table(s, d, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("token_id"), F.col("event_type").alias("tool"), "ts", (F.col("user_id") > 20).alias("alpha")
    )


def tenant_stats(s, d):
    out = T.tenant_stats(_tenants(s, d), _calls(s, d), NOW)
    tools = F.array_join(F.transform(F.map_entries("top_tools"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("top_tools", tools)


def tenant_profile(s, d):
    ent = table(s, d, "supplier").select(
        F.col("s_suppkey").alias("token_id"), F.col("s_name").alias("organization_id"), F.concat(F.lit("w"), F.col("s_nationkey").cast("string")).alias("workspace_id"),
        F.when(F.col("s_acctbal") > 5000, "pro").alias("plan"),
    )
    usage = _calls(s, d).groupBy("token_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("calls"))
    return T.tenant_profile(_tenants(s, d), ent, usage, NOW).drop("revoked_at")


def quota_admission(s, d):
    quotas = _tenants(s, d).select("token_id", (F.col("daily_quota") % 4).alias("daily_quota"))
    return T.quota_admission(_calls(s, d), quotas).select("call_id", F.col("day").cast("string").alias("day"), "n", "admitted")


def contribution_admission(s, d):
    return T.contribution_admission(_calls(s, d), LIMITS).select("call_id", F.col("day").cast("string").alias("day"), "n", "admitted")


def daily_calls(s, d):
    return T.daily_calls(_calls(s, d)).withColumn("day", F.col("day").cast("string"))


def decisions(s, d):
    """Views are searches, clicks prompt pushes, errors error pushes; a value above 10 served its record."""
    e = _events(s, d).where(F.col("event_type").isin("view", "click", "error"))
    hit = F.struct(X.record_id("k").alias("id"), F.col("value").alias("score"))
    served = F.when(F.col("value") > 40, F.array(hit, hit)).when(F.col("value") > 10, F.array(hit)).otherwise(F.array().cast("array<struct<id:string,score:double>>"))
    return e.select(
        "event_id", _ts().alias("ts"), F.when(F.col("event_type") == "view", "search").otherwise("push").alias("channel"),
        F.when(F.col("event_type") == "click", "prompt").when(F.col("event_type") == "error", "error").alias("trigger"),
        _session().alias("session"), X.salted_hash(SALT, F.col("k").cast("string")).alias("query_hash"), F.col("props").alias("query_text"),
        served.alias("served"), F.size(served).alias("count"),
    )


def outcomes(s, d):
    """Purchases and signups judge the record they name."""
    e = _events(s, d).where(F.col("event_type").isin("purchase", "signup"))
    used = F.when(F.col("value") > 5, F.col("event_type") == "purchase")
    return e.select(
        _ts().alias("ts"), F.lit("").alias("exposure_id"), _session().alias("session_hash"), X.record_id("k").alias("record_id"),
        used.alias("used"), (F.coalesce(used, F.lit(False)) & (F.col("value") > 20)).alias("confirmed"), F.col("value").between(3, 7).alias("incorrect"),
    )


def cohorts(s, d):
    return table(s, d, "customer").where(F.col("c_nationkey") < 20).select(
        F.concat(F.lit("team"), F.col("c_nationkey").cast("string")).alias("team"), X.salted_hash(SALT, F.col("c_custkey").cast("string")).alias("session_hash")
    )


def metrics_digest(s, d):
    return T.metrics_digest(decisions(s, d), NOW_TS, 24.0 * 7)


def served_in_session(s, d):
    return T.served_in_session(decisions(s, d))


def attribute_helpfulness(s, d):
    v = _events(s, d).where(F.col("event_type") == "purchase").select(_session().alias("session"), X.record_id("k").alias("record_id"), (F.col("value") > 10).alias("used"))
    return T.attribute_helpfulness(v, T.served_in_session(decisions(s, d)))


def exposure_ids(s, d):
    return M.exposure_ids(decisions(s, d).drop("event_id", "query_text", "count")).select("exposure_id", "record_id", "ts", "channel", "trigger", "ordinal")


def _exposures(s, d):
    dec = M.cohort_join(M.arm_filter(decisions(s, d), BASELINE, TREATMENT), cohorts(s, d))
    return M.exposure_ids(dec.select("ts", "channel", "trigger", "session", "query_hash", "served", "arm", "team"))


def arm_filter(s, d):
    return M.arm_filter(decisions(s, d), BASELINE, TREATMENT).select("event_id", "arm")


def cohort_join(s, d):
    return M.cohort_join(decisions(s, d), cohorts(s, d)).select("event_id", "team")


def _all_outcomes(s, d, exposures):
    """Outcomes without a name, and such as name an exposure: by the exposure's first digits some
    once, some twice, some with another record, and some of an exposure that does not exist."""
    at = lambda i: F.substring("exposure_id", i, 1)
    e = exposures.select("exposure_id", "session", "record_id", "ts")
    times = F.when(at(1) == "4", 2).otherwise(1)
    claims = e.where(at(1) <= "5").withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(
        "ts", "exposure_id", F.col("session").alias("session_hash"), F.when(at(1) == "5", "exp-none").otherwise(F.col("record_id")).alias("record_id"),
        (at(2) < "8").alias("used"), (at(2) < "4").alias("confirmed"), (at(2) > "d").alias("incorrect"),
    )
    unknown = e.where(at(1) == "6").select(
        "ts", F.concat(F.lit("x"), F.substring("exposure_id", 2, 31)).alias("exposure_id"), F.col("session").alias("session_hash"), "record_id",
        F.lit(True).alias("used"), F.lit(False).alias("confirmed"), F.lit(False).alias("incorrect"),
    )
    return outcomes(s, d).unionByName(claims).unionByName(unknown)


def attribute_outcomes(s, d):
    e = _exposures(s, d)
    keys = ["exposure_id", "record_id", "arm", "team", "used", "confirmed", "incorrect"]
    return M.attribute_outcomes(e, _all_outcomes(s, d, e))[0].groupBy(*keys).agg(F.count("*").alias("n"))


def outcome_errors(s, d):
    e = _exposures(s, d)
    return M.attribute_outcomes(e, _all_outcomes(s, d, e))[1].groupBy("session", "record_id", "problem").agg(F.count("*").alias("n"))


def pilot_metrics(s, d):
    every = _all_outcomes(s, d, _exposures(s, d))
    return sinks.pilot_rows(M.pilot_metrics(decisions(s, d), every, cohorts(s, d), BASELINE, TREATMENT))


def parse_decisions(s, d):
    e = decisions(s, d)
    v = F.col("event_id") % 11
    row = e.select(
        "event_id",
        F.to_json(
            F.struct(
                F.when(v == 1, "yesterday").otherwise(F.col("ts")).alias("ts"), F.when(v == 2, "email").otherwise(F.col("channel")).alias("channel"),
                F.when(v == 3, "zz").otherwise(F.col("query_hash")).alias("query_hash"), F.when(v == 4, F.col("query_text")).alias("query_text"),
                F.col("session"), F.when(v == 5, F.lit(9)).otherwise(F.col("count")).alias("count"), F.col("served"), F.when(v == 6, "later").otherwise(F.col("trigger")).alias("trigger"),
                F.when(v == 7, F.lit(1)).alias("extra"),
            )
        ).alias("value"),
    )
    lines = row.select(F.col("event_id").cast("string").alias("file"), F.when(F.col("event_id") % 11 == 8, F.substring("value", 2, 100)).otherwise(F.col("value")).alias("value"))
    return L.parse_decisions(lines).select(F.col("file").alias("event_id"), F.coalesce("problem", F.lit("")).alias("problem"))


def overlap_snapshot(s, d):
    rows = _events(s, d).select(F.col("user_id").alias("file"), F.lit("").alias("raw"), F.lit("").alias("problem"), "event_type", "k")
    return L.overlap_snapshot(rows)


def outcome_problems(s, d):
    return outcomes(s, d).select(F.coalesce(L.outcome_problem(), F.lit("")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def cohort_conflicts(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderpriority").alias("team"), X.salted_hash(SALT, F.col("o_custkey").cast("string")).alias("session_hash"))
    return L.cohort_conflicts(rows)


def idf_lines(s, d):
    turns = table(s, d, "conversations")
    return sinks.idf_lines(G.build_idf(turns), turns.count())


QUERIES = {
    f.__name__: f
    for f in (
        usage_counters, record_usage, top_records, status_counts, tenant_stats, tenant_profile, quota_admission, contribution_admission,
        daily_calls, metrics_digest, served_in_session, attribute_helpfulness, exposure_ids, arm_filter, cohort_join,
        attribute_outcomes, outcome_errors, pilot_metrics, parse_decisions, overlap_snapshot, outcome_problems, cohort_conflicts, idf_lines,
    )
}

EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_HASH = lambda e: f"substr(sha256('{SALT}' || {e}), 1, 32)"
USE = f"""{EV}, use AS (SELECT {Q.rid('k')} AS record_id, CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'push' WHEN 'purchase' THEN 'confirm' END AS action, CAST(ts AS DATE) AS day FROM ev
    WHERE event_type IN ('view', 'click', 'purchase'))"""
_COUNTS = """count(*) FILTER (action = 'retrieve') AS retrieved, count(*) FILTER (action = 'push') AS pushed, count(*) FILTER (action = 'confirm') AS confirmed_helpful,
    CAST(max(day) FILTER (action = 'retrieve') AS VARCHAR) AS last_hit"""
TENANTS = "tenants AS (SELECT c_custkey AS token_id, c_name AS label, c_acctbal < 0 AS revoked, CAST(c_nationkey AS BIGINT) AS daily_quota FROM customer)"
DEC = f"""{EV}, dec AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, ts AS t, CASE event_type WHEN 'view' THEN 'search' ELSE 'push' END AS channel,
    CASE event_type WHEN 'click' THEN 'prompt' WHEN 'error' THEN 'error' END AS trigger, {_HASH('user_id')} AS session, {_HASH('k')} AS query_hash, {Q.rid('k')} AS record_id,
    CASE WHEN value > 40 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END AS cnt, user_id, props FROM ev WHERE event_type IN ('view', 'click', 'error'))"""
ARMS = """arms AS (SELECT *, CASE WHEN date_trunc('second', t) >= '2024-01-03' AND date_trunc('second', t) < '2024-01-14' THEN 'baseline'
    WHEN date_trunc('second', t) >= '2024-01-14' AND date_trunc('second', t) < '2024-01-27 12:00:00' THEN 'treatment' END AS arm,
    coalesce('team' || c_nationkey, 'unattributed') AS team FROM dec LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = user_id)"""


def _expo(source: str, extra: str = "") -> str:
    parts = ["'exposure-v1'", "ts", "channel", "coalesce(trigger, '')", "session", "query_hash", "record_id", "ordinal"]
    text = " || ".join(f"{p} || chr(0)" for p in parts)
    return f"""expo AS (SELECT substr(sha256({text}), 1, 32) AS exposure_id, * FROM (
      SELECT *, row_number() OVER (PARTITION BY ts, channel, trigger, session, query_hash, record_id ORDER BY event_id) - 1 AS ordinal
      FROM (SELECT {source}.*, unnest(range(cnt)) AS copy FROM {source}){extra}))"""


OUT = f"""outc AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, {_HASH('user_id')} AS session, {Q.rid('k')} AS record_id,
    CASE WHEN value > 5 THEN event_type = 'purchase' END AS used, coalesce(CASE WHEN value > 5 THEN event_type = 'purchase' END, false) AND value > 20 AS confirmed, value BETWEEN 3 AND 7 AS incorrect
    FROM ev WHERE event_type IN ('purchase', 'signup'))"""
_EXPO_ARMS = _expo("arms", " WHERE arm IS NOT NULL")


# Outcomes that name an exposure, then the others first in, first out over the exposures nobody names.
_ZIP = """nm AS (SELECT ts, exposure_id AS named, session, CASE WHEN exposure_id[1] = '5' THEN 'exp-none' ELSE record_id END AS record_id,
      exposure_id[2] < '8' AS used, exposure_id[2] < '4' AS confirmed, exposure_id[2] > 'd' AS incorrect
    FROM (SELECT *, unnest(range(CASE WHEN exposure_id[1] = '4' THEN 2 ELSE 1 END)) AS again FROM expo) WHERE exposure_id[1] <= '5'
    UNION ALL SELECT ts, 'x' || exposure_id[2:], session, record_id, true, false, false FROM expo WHERE exposure_id[1] = '6'),
  nj AS (SELECT nm.*, e.exposure_id, e.arm, e.team, coalesce(e.session = nm.session AND e.record_id = nm.record_id, false) AS ok FROM nm LEFT JOIN expo e ON named = e.exposure_id),
  nc AS (SELECT *, count(*) OVER (PARTITION BY exposure_id) AS claims FROM nj WHERE ok),
  slots AS (SELECT *, row_number() OVER (PARTITION BY session, record_id ORDER BY ts, exposure_id) AS slot FROM expo WHERE exposure_id NOT IN (SELECT named FROM nm)),
  ro AS (SELECT *, row_number() OVER (PARTITION BY session, record_id ORDER BY ts, coalesce(CAST(used AS INT), -1), CAST(confirmed AS INT), CAST(incorrect AS INT)) AS slot FROM outc),
  zipped AS (SELECT ro.session, ro.record_id, exposure_id, arm, team, used, confirmed, incorrect FROM ro LEFT JOIN slots USING (session, record_id, slot)),
  matched AS (SELECT session, record_id, exposure_id, arm, team, used, confirmed, incorrect FROM nc WHERE claims = 1
    UNION ALL SELECT * FROM zipped WHERE exposure_id IS NOT NULL)"""


def _w(num, den):
    z = "1.959963984540054e0"
    p, n = f"({num} / {den})", f"CAST({den} AS DOUBLE)"
    c = f"(({p} + {z} * {z} / (2e0 * {n})) / (1e0 + {z} * {z} / {n}))"
    h = f"({z} * sqrt({p} * (1e0 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n})) / (1e0 + {z} * {z} / {n}))"
    fmt = lambda e: f"printf('%.6f', CASE WHEN {den} > 0 THEN {e} ELSE 0e0 END)"
    return fmt(p), fmt(f"greatest(0e0, {c} - {h})"), fmt(f"least(1e0, {c} + {h})")


def _pilot_select() -> str:
    rates = [
        ("hit_rate", "hit", "exposed_decisions", "decisions"), ("outcome_coverage", "outcome_coverage", "judged", "exposures"), ("used_rate", "used", "used", "judged"),
        ("helpful_rate", "helpful", "confirmed", "exposures"), ("incorrect_rate", "incorrect", "incorrect", "judged"), ("repeated_error_rate", "repeated_error", "repeated_errors", "error_decisions"),
    ]
    cols = []
    for value, name, num, den in rates:
        for col, e in zip((value, f"{name}_low_95", f"{name}_high_95"), _w(num, den)):
            blank = "scope = 'record'" if name in ("hit", "repeated_error") else "false"
            cols.append(f"CASE WHEN {blank} THEN '' ELSE {e} END AS {col}")
    counts = "decisions exposed_decisions exposures judged used confirmed incorrect error_decisions repeated_errors".split()
    return ", ".join(["scope", "arm", "team", "record_id", *[f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in counts], *cols])


PILOT = f"""WITH {DEC}, {ARMS}, {_EXPO_ARMS}, {OUT}, {_ZIP},
  ina AS (SELECT * FROM arms WHERE arm IS NOT NULL),
  pq AS (SELECT arm, team, session, query_hash, count(*) AS decisions, count(*) FILTER (cnt > 0) AS exposed, sum(cnt) AS exposures, count(*) FILTER (trigger = 'error') AS errs,
    greatest(count(*) FILTER (trigger = 'error') - 1, 0) AS rep FROM ina GROUP BY ALL),
  lv AS (SELECT CASE WHEN grouping(team) = 1 THEN 'aggregate' ELSE 'team' END AS scope, arm, coalesce(team, '') AS team, '' AS record_id, CAST(sum(decisions) AS BIGINT) AS decisions,
    CAST(sum(exposed) AS BIGINT) AS exposed_decisions, CAST(sum(exposures) AS BIGINT) AS exposures, CAST(sum(errs) AS BIGINT) AS error_decisions, CAST(sum(rep) AS BIGINT) AS repeated_errors
    FROM pq GROUP BY GROUPING SETS ((arm), (arm, team))),
  rec AS (SELECT 'record' AS scope, arm, team, record_id, NULL::BIGINT AS decisions, NULL::BIGINT AS exposed_decisions, count(*) AS exposures, NULL::BIGINT AS error_decisions, NULL::BIGINT AS repeated_errors
    FROM expo GROUP BY arm, team, record_id),
  m AS (SELECT * FROM matched),
  js AS (SELECT CASE WHEN grouping(team) = 1 THEN 'aggregate' WHEN grouping(record_id) = 1 THEN 'team' ELSE 'record' END AS scope, arm, coalesce(team, '') AS team, coalesce(record_id, '') AS record_id,
    count(*) FILTER (used IS NOT NULL OR incorrect) AS judged, count(*) FILTER (used) AS used, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (incorrect) AS incorrect
    FROM m GROUP BY GROUPING SETS ((arm), (arm, team), (arm, team, record_id))),
  seeds AS (SELECT 'aggregate' AS scope, unnest(['baseline', 'treatment']) AS arm),
  fr AS (SELECT scope, arm, '' AS team, '' AS record_id, coalesce(decisions, 0) AS decisions, coalesce(exposed_decisions, 0) AS exposed_decisions, coalesce(exposures, 0) AS exposures,
      coalesce(error_decisions, 0) AS error_decisions, coalesce(repeated_errors, 0) AS repeated_errors FROM seeds LEFT JOIN lv USING (scope, arm)
    UNION ALL SELECT * FROM lv WHERE scope = 'team' UNION ALL SELECT * FROM rec),
  fin AS (SELECT fr.*, coalesce(judged, 0) AS judged, coalesce(used, 0) AS used, coalesce(confirmed, 0) AS confirmed, coalesce(incorrect, 0) AS incorrect FROM fr LEFT JOIN js USING (scope, arm, team, record_id))
  SELECT {_pilot_select()} FROM fin"""

SQL = {
    "usage_counters": f"WITH {USE} SELECT coalesce(record_id, 'TOTAL') AS record_id, {_COUNTS} FROM use GROUP BY ROLLUP (record_id)",
    "record_usage": f"""WITH {Q.CORPUS}, {USE}, u AS (SELECT record_id, {_COUNTS} FROM use GROUP BY record_id)
      SELECT record_id, coalesce(retrieved, 0) AS retrieved, coalesce(pushed, 0) AS pushed, coalesce(confirmed_helpful, 0) AS confirmed_helpful, coalesce(last_hit, '') AS last_hit FROM corpus LEFT JOIN u USING (record_id)""",
    "top_records": f"""WITH {Q.CORPUS}, {USE}, u AS (SELECT record_id, {_COUNTS} FROM use GROUP BY record_id)
      SELECT record_id, retrieved, pushed, title FROM u JOIN corpus USING (record_id) ORDER BY retrieved + pushed DESC, record_id LIMIT 10""",
    "status_counts": f"WITH {Q.CORPUS} SELECT count(*) AS total, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'quarantined') AS quarantined FROM corpus",
    "tenant_stats": f"""WITH {TENANTS}, w AS (SELECT user_id AS token_id, event_type AS tool, count(*) AS n, count(*) FILTER (CAST(ts AS DATE) = '{NOW}') AS td FROM events
        WHERE CAST(ts AS DATE) > DATE '{NOW}' - 7 AND CAST(ts AS DATE) <= '{NOW}' GROUP BY ALL),
      a AS (SELECT token_id, CAST(sum(td) AS BIGINT) AS calls_today, CAST(sum(n) AS BIGINT) AS calls_window, string_agg(tool || '=' || n, ',' ORDER BY tool) AS top_tools FROM w GROUP BY token_id)
      SELECT token_id, label, revoked, daily_quota, coalesce(calls_today, 0) AS calls_today, coalesce(calls_window, 0) AS calls_window, coalesce(top_tools, '') AS top_tools FROM tenants LEFT JOIN a USING (token_id)""",
    "tenant_profile": f"""WITH {TENANTS}, u AS (SELECT user_id AS token_id, count(*) AS calls FROM events WHERE CAST(ts AS DATE) = '{NOW}' GROUP BY 1)
      SELECT token_id, label, daily_quota, coalesce(s_name, '') AS organization_id, coalesce('w' || s_nationkey, '') AS workspace_id, CASE WHEN s_acctbal > 5000 THEN 'pro' ELSE '' END AS plan, coalesce(calls, 0) AS calls_today
      FROM tenants LEFT JOIN supplier ON s_suppkey = token_id LEFT JOIN u USING (token_id)""",
    "quota_admission": """WITH r AS (SELECT event_id AS call_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
      SELECT call_id, day, n, coalesce(c_nationkey % 4 <= 0 OR n <= c_nationkey % 4, false) AS admitted FROM r LEFT JOIN customer ON c_custkey = user_id""",
    "contribution_admission": """WITH r AS (SELECT event_id AS call_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
      SELECT call_id, day, n, user_id <= 20 OR n <= CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END AS admitted FROM r""",
    "daily_calls": "SELECT user_id AS token_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL",
    "metrics_digest": f"""WITH {DEC}, r AS (SELECT * FROM dec WHERE date_trunc('second', t) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY),
      p AS (SELECT channel AS section, '' AS key, count(*) AS queries, count(*) FILTER (cnt > 0) AS served FROM r GROUP BY channel
        UNION ALL SELECT 'trigger', trigger, count(*), count(*) FILTER (cnt > 0) FROM r WHERE channel = 'push' GROUP BY trigger
        UNION ALL SELECT * FROM (SELECT 'top', record_id, NULL, CAST(sum(cnt) AS BIGINT) FROM r WHERE channel = 'push' AND cnt > 0 GROUP BY record_id ORDER BY 4 DESC, 2 LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'sample', substr(props, 1, 80), NULL, NULL FROM r WHERE channel = 'push' AND cnt > 0 AND props <> '' ORDER BY date_trunc('second', t), props LIMIT 3))
      SELECT section, key, queries, served, CASE WHEN queries IS NOT NULL THEN round(served / queries * 100, 1) END AS rate FROM p""",
    "served_in_session": f"WITH {DEC} SELECT DISTINCT session, record_id FROM dec WHERE cnt > 0",
    "attribute_helpfulness": f"""WITH {DEC} SELECT DISTINCT {_HASH('user_id')} AS session, {Q.rid('k')} AS record_id FROM ev WHERE event_type = 'purchase' AND value > 10
      AND ({_HASH('user_id')}, {Q.rid('k')}) IN (SELECT (session, record_id) FROM dec WHERE cnt > 0)""",
    "exposure_ids": f"WITH {DEC}, {_expo('dec')} SELECT exposure_id, record_id, ts, channel, coalesce(trigger, '') AS trigger, ordinal FROM expo",
    "arm_filter": f"WITH {DEC}, {ARMS} SELECT event_id, arm FROM arms WHERE arm IS NOT NULL",
    "cohort_join": f"WITH {DEC}, {ARMS} SELECT event_id, team FROM arms",
    "attribute_outcomes": f"WITH {DEC}, {ARMS}, {_EXPO_ARMS}, {OUT}, {_ZIP} SELECT exposure_id, record_id, arm, team, used, confirmed, incorrect, count(*) AS n FROM matched GROUP BY ALL",
    "outcome_errors": f"""WITH {DEC}, {ARMS}, {_EXPO_ARMS}, {OUT}, {_ZIP}, er AS (SELECT session, record_id, 'no_unclaimed_exposure' AS problem FROM zipped WHERE exposure_id IS NULL
        UNION ALL SELECT session, record_id, 'unknown_or_mismatched_exposure' FROM nj WHERE NOT ok UNION ALL SELECT session, record_id, 'duplicate_outcome' FROM nc WHERE claims > 1)
      SELECT session, record_id, problem, count(*) AS n FROM er GROUP BY ALL""",
    "pilot_metrics": PILOT,
    "parse_decisions": f"""WITH {DEC} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 11 WHEN 1 THEN 'timestamp' WHEN 2 THEN 'channel' WHEN 3 THEN 'query_hash' WHEN 4 THEN 'query_text_forbidden'
      WHEN 5 THEN 'count' WHEN 6 THEN 'trigger' WHEN 7 THEN 'unknown_key' WHEN 8 THEN 'malformed' ELSE '' END AS problem FROM dec""",
    "overlap_snapshot": f"""WITH {EV}, c AS (SELECT user_id, event_type, k, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT event_type, k, max(n) AS n FROM c GROUP BY ALL)
      SELECT event_type, k FROM m, unnest(range(n))""",
    "outcome_problems": f"""WITH {EV}, {OUT} SELECT CASE WHEN used IS NULL AND NOT confirmed AND NOT incorrect THEN 'no_signal' WHEN confirmed AND incorrect THEN 'contradiction'
      WHEN confirmed AND NOT coalesce(used, false) THEN 'confirmed_without_use' ELSE '' END AS problem, count(*) AS n FROM outc GROUP BY 1""",
    "cohort_conflicts": f"SELECT {_HASH('o_custkey')} AS session_hash, count(DISTINCT o_orderpriority) AS teams FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "idf_lines": f"""WITH i AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({Q.fields('lower(text)')})) AS word FROM conversations) WHERE regexp_matches(word, '[\\p{{L}}\\p{{Nd}}]') GROUP BY word)
      SELECT 'docs' || chr(9) || (SELECT count(*) FROM conversations) AS value UNION ALL SELECT word || chr(9) || df FROM i""",
}
