"""Registered queries: evaluation, votes, lifecycle decisions and watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import similarity as SM
from . import content
from . import logs as LP
from . import sqltext as Q
from .content import NOW, _shingles
from .tables import benchmark_queries, document_tokens, records, table

TRUTH = 0.5
CHECKS = L.CHECKS
RUN_STAMP = "2024-01-31 06:00:00"


def _truth(s, d):
    """Each benchmark passage with the document that contains most of it (lowest id on ties)."""
    items = table(s, d, "benchmark").select(F.col("item_id").alias("draft_id"), "text")
    docs = table(s, d, "documents").select(X.record_id("doc_id").alias("ref_id"), "text")
    pairs = SM.containment_join(items, docs, threshold=TRUTH)
    best = pairs.groupBy("draft_id").agg(F.min(F.struct((-F.col("shared")).alias("n"), F.col("ref_id").alias("r"))).alias("b"))
    return best.select(F.col("draft_id").alias("case_id"), F.col("b.r").alias("record_id"))


def retrieval_eval(s, d):
    hits = R.bm25_topk(benchmark_queries(s, d), document_tokens(s, d), 3).withColumnRenamed("query_id", "case_id")
    out = E.retrieval_eval(_truth(s, d), hits, 3)
    return out.select("cases", "found", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "mrr", "near_miss_rate")])


def push_eval(s, d):
    dec = LP.decisions(s, d).where(F.col("channel") == "push")
    number = F.regexp_extract("query_text", r"(\d+)", 1).cast("bigint")
    cases = dec.select(
        F.col("event_id").alias("case_id"), F.when(F.col("trigger") == "error", X.record_id(number + F.col("event_id") % 2)).otherwise("").alias("expect_id")
    )
    hits = dec.select(F.col("event_id").alias("case_id"), F.posexplode("served").alias("rank", "h")).select("case_id", "rank", F.col("h.id").alias("record_id"))
    out = E.push_eval(cases, hits)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def usage_eval(s, d):
    served = LP.served_in_session(s, d)
    bought = LP._events(s, d).where(F.col("event_type") == "purchase").select(LP._session().alias("session"), X.record_id("k").alias("record_id")).distinct().withColumn("hit", F.lit(True))
    labels = served.join(bought, ["session", "record_id"], "left").groupBy(F.col("session").alias("name")).agg(
        F.collect_set("record_id").alias("served"), F.collect_set(F.when(F.col("hit"), F.col("record_id"))).alias("used")
    )
    verdicts = LP._events(s, d).where(F.col("event_type") == "signup").select(LP._session().alias("name"), X.record_id("k").alias("record_id"), (F.col("value") > 5).alias("used"))
    out = E.usage_eval(labels, verdicts)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def _votes(s, d):
    e = LP._events(s, d).where(F.col("event_type").isin("view", "click", "purchase"))
    good = F.col("value") > 15
    failing = (F.col("user_id") % 5).cast("int")
    checks = F.transform(
        F.array(*[F.lit(c) for c in CHECKS]),
        lambda c, i: F.struct(c.alias("check"), (good | (i != failing)).alias("pass")),
    )
    return e.select(
        F.col("event_type").alias("config"), F.col("k").alias("case_id"), F.col("event_id").alias("sample"),
        F.when(good, "approve").otherwise("reject").alias("decision"),
        F.when(F.col("value") > 35, F.slice(checks, 1, 4)).otherwise(checks).alias("checks"),
        F.when(F.col("value") < 2, "timeout").otherwise("").alias("error"),
    )


def _cases(s, d):
    k = LP._events(s, d).select(F.col("k").alias("case_id")).distinct()
    return k.select(
        "case_id", F.concat(F.lit("m"), (F.col("case_id") % 4).cast("string")).alias("mode"),
        F.when(F.col("case_id") % 2 == 0, "approve").otherwise("reject").alias("want_decision"),
        F.array(F.element_at(F.array(*[F.lit(c) for c in CHECKS]), (F.col("case_id") % 5 + 1).cast("int"))).alias("want_checks"),
    )


def judge_outcomes(s, d):
    return E.case_outcomes(_cases(s, d), _votes(s, d)).withColumn("got", F.coalesce("got", F.lit("")))


def judge_eval(s, d):
    out = E.judge_eval(E.case_outcomes(_cases(s, d), _votes(s, d)))
    for c in ("false_approve_rate", "false_reject_rate", "accuracy", "check_recall"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("place", F.col("place").cast("bigint"))


def judge_eval_by_mode(s, d):
    return E.judge_eval_by_mode(E.case_outcomes(_cases(s, d), _votes(s, d)), ("m3", "m1", "m2", "m0"))


def verdict_approved(s, d):
    return L.verdict_approved(_votes(s, d)).select("sample", "approved")


def arm_eval(s, d):
    o = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("trap_id"), (F.col("l_linestatus") == "O").alias("memory_on"), (F.col("l_returnflag") == "R").alias("avoided"),
        F.col("l_linenumber").alias("steps"), F.col("l_quantity").cast("bigint").alias("tokens"),
    )
    out = E.arm_eval(o)
    return out.withColumn("avoidance_off", F.round("avoidance_off", 6)).withColumn("avoidance_on", F.round("avoidance_on", 6))


def prospect_funnel(s, d):
    p = F.col("o_orderpriority")
    o = table(s, d, "orders").select(
        (F.col("o_orderstatus") != "F").alias("eligible"), (p != "5-LOW").alias("supported"),
        F.when(F.col("o_totalprice") > 450000, "leak").when(F.col("o_totalprice") < 50000, "irrelevant").otherwise("ok").alias("guard"),
        (F.col("o_custkey") % 10 != 3).alias("deps_ok"), (F.col("o_custkey") % 10 != 4).alias("control_ok"),
        (p == "1-URGENT").alias("off_avoided"), (p == "2-HIGH").alias("on_avoided"),
    )
    return E.prospect_funnel(o)


def latency_stats(s, d):
    e = table(s, d, "events")
    calls = e.select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("ms"), (F.col("value") > 15).alias("approved"), F.when(F.col("value") < 1, "x").otherwise("").alias("error"))
    return E.latency_stats(calls, ["event_type"])


def _line_votes(s, d):
    return table(s, d, "lineitem").select(
        X.record_id("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("sample"), (F.col("l_quantity") > 20).alias("approved"),
        F.when(F.col("l_tax") > 0.07, "timeout").otherwise("").alias("error"), "l_discount", "l_suppkey",
    )


def majority_vote(s, d):
    v = _line_votes(s, d).groupBy("record_id", "sample").agg(F.bool_and("approved").alias("approved"), F.max("error").alias("error"), F.max("l_discount").alias("disc"))
    secondary = v.select("record_id", "sample", (F.col("disc") > 0.02).alias("approved"), F.when(F.col("disc") > 0.05, "down").otherwise("").alias("error"))
    return L.majority_vote(v.drop("disc"), secondary).withColumn("approved", F.coalesce(F.col("approved").cast("string"), F.lit("none")))


def panel_vote(s, d):
    family = F.element_at(F.array(F.lit("Ash"), F.lit("birch"), F.lit("cedar"), F.lit("elm")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    v = _line_votes(s, d).withColumn("model", F.concat(family, F.lit("-"), F.col("sample").cast("string")))
    return L.panel_vote(v.select("record_id", "model", "approved", "error"))


def _repro_results(s, d):
    q = F.col("l_quantity")
    status = F.when(q < 15, "skipped").when(q < 46, "holds").when(q < 49, "broken").otherwise("error")
    return table(s, d, "lineitem").select(
        X.record_id("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("label"), F.col("l_partkey").cast("string").alias("path"), F.lit("positive").alias("kind"), status.alias("status")
    )


def attestation_rollup(s, d):
    return L.attestation_rollup(_repro_results(s, d)).withColumn("reproduced_under", F.array_join("reproduced_under", ","))


def _judged(s, d):
    e = table(s, d, "embeddings")
    return e.select(
        X.record_id("vec_id").alias("record_id"), F.when(F.col("label") == 3, F.lit(None).cast("boolean")).otherwise(F.col("label") % 2 == 0).alias("approved"), F.lit("ash+elm").alias("models")
    )


def _lifecycle_records(s, d):
    """Corpus records where src1 is past its window and every English record has a positive repro."""
    until = F.when(F.col("applies_to")[0]["package"] == "src1", "2024-03-01")
    repro = F.when(F.col("applies_to")[0]["ecosystem"] == "en", "repro.sh")
    guard = F.struct(repro.alias("repro"), F.lit(None).cast("array<struct<path:string,kind:string,label:string>>").alias("repros"), F.lit(None).cast("string").alias("guarding_test"))
    r = records(s, d)
    return r.withColumn("guard", guard).withColumn("provenance", F.col("provenance").withField("valid", F.struct(F.lit("2024-01-01").alias("from"), until.cast("string").alias("until"))))


def promote(s, d):
    out = L.promote(_lifecycle_records(s, d), L.attestation_rollup(_repro_results(s, d)), _judged(s, d), NOW)
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in out.columns])


def repromote(s, d):
    out = L.repromote(_lifecycle_records(s, d), L.attestation_rollup(_repro_results(s, d)), _judged(s, d), NOW)
    return out.withColumn("validated_at", F.coalesce("validated_at", F.lit("")))


def _with_reports(s, d):
    r = records(s, d)
    e = LP._events(s, d).where(F.col("event_type") == "error")
    rows = e.select(X.record_id(F.col("event_id") + 1000000).alias("id"), X.record_id(F.col("k") * 11).alias("disputes"))
    lite = r.select("id", "status", F.col("provenance.disputes").alias("disputes"))
    both = lite.unionByName(rows.select("id", F.lit("quarantined").alias("status"), "disputes"))
    return both.select("id", "status", F.struct("disputes").alias("provenance"))


def dispute_join(s, d):
    joined, orphans = L.dispute_join(_with_reports(s, d))
    return joined.unionByName(orphans.select("report_id", "record_id", F.lit("orphan").alias("record_status"), F.lit(0).cast("bigint").alias("reports")))


def adapt(s, d):
    e = LP._events(s, d).where(F.col("event_type") == "error")
    rid = X.record_id(F.col("event_id") + 1000000).alias("report_id")
    v = F.col("value")
    evidence = e.select(rid, (v < 30).alias("original_holds"), (v < 5).alias("original_inconclusive"), (v > 25).alias("counter_holds"), (v < 12).alias("counter_inconclusive"))
    verdicts = e.where(v > 26).select(rid, (v < 40).alias("approved"))
    out = L.adapt(_with_reports(s, d), evidence, verdicts, NOW)
    return out.select("report_id", "record_id", "action", "reason", F.coalesce("to_status", F.lit("")).alias("to_status"), F.coalesce("valid_until", F.lit("")).alias("valid_until"))


GUARDS = L.Guardrails(max_actions=700, max_action_rate=0.4, min_sample=100, max_runs=4000)


def _batch(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "P").alias("eligible"), (F.col("o_totalprice") > 250000).alias("promoted"))


def guarded_batch(s, d):
    summary = L.guarded_batch(_batch(s, d), GUARDS)[1]
    return summary.withColumn("rate", F.round("rate", 6))


def guarded_prefix(s, d):
    return L.guarded_batch(_batch(s, d), GUARDS)[0].select("seq", "eligible", "promoted")


def hold_cooldown(s, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "held").when(F.col("o_orderstatus") == "O", "promoted").otherwise("ineligible")
    actions = table(s, d, "orders").select(X.record_id("o_custkey").alias("id"), outcome.alias("outcome"), F.col("o_orderdate").alias("at"))
    recs = table(s, d, "customer").select(X.record_id("c_custkey").alias("id"))
    kept, ledger = L.hold_cooldown(recs, actions, "2001-06-01 00:00:00", days=400)
    return kept.select("id", F.lit("kept").alias("part"), F.lit("").alias("held_at")).unionByName(
        ledger.select("id", F.lit("held").alias("part"), F.col("held_at").cast("string").alias("held_at"))
    )


def run_counts(s, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "held").when(F.col("o_orderstatus") == "O", "promoted").otherwise("ineligible")
    a = table(s, d, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("run_id"), F.col("o_orderpriority").alias("stage"), outcome.alias("outcome"))
    return L.run_counts(a, ("promoted", "held", "ineligible"))


def liveness_alarm(s, d):
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("pipeline"), F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") > 300000).cast("bigint").alias("promoted"))
    backlog = table(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("pipeline")).agg(F.count("*").alias("eligible"))
    return L.liveness_alarm(runs, backlog, 3)


def growth_watch(s, d):
    snaps = table(s, d, "events").select(F.col("user_id").alias("corpus"), "ts", F.col("value").cast("bigint").alias("validated"))
    out = L.growth_watch(snaps, RUN_STAMP, 24 * 12)
    return out.withColumn("last_growth", F.date_format("last_growth", "yyyy-MM-dd HH:mm:ss"))


def stall_watch(s, d):
    items = table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("opened_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "failure").otherwise("open").alias("state"))
    return L.stall_watch(items, "1998-01-01 00:00:00").select("item_id", "state", "age_min")


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_eval, push_eval, usage_eval, judge_outcomes, judge_eval, judge_eval_by_mode, verdict_approved, arm_eval, prospect_funnel,
        latency_stats, majority_vote, panel_vote, attestation_rollup, promote, repromote, dispute_join, adapt, guarded_batch,
        guarded_prefix, hold_cooldown, run_counts, liveness_alarm, growth_watch, stall_watch,
    )
}

TRUTH_SQL = f"""bw AS (SELECT item_id, {Q.words('text')} AS w FROM benchmark), bs AS (SELECT item_id, {_shingles('w')} AS s FROM bw), bx AS (SELECT item_id, len(s) AS total, unnest(s) AS sh FROM bs),
  dw AS (SELECT {Q.rid('doc_id')} AS record_id, {Q.words('text')} AS w FROM documents), dx AS (SELECT record_id, unnest({_shingles('w')}) AS sh FROM dw),
  pr AS (SELECT item_id, record_id, count(*) AS shared FROM bx JOIN dx USING (sh) GROUP BY item_id, record_id, total HAVING count(*) / total >= {TRUTH}),
  truth AS (SELECT item_id AS case_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, record_id) AS n FROM pr) WHERE n = 1)"""
_CK = "[" + ", ".join(Q.q(c) for c in CHECKS) + "]"
JUDGE = f"""{LP.EV}, vt AS (SELECT event_type AS config, k AS case_id, event_id AS sample, value BETWEEN 15 AND 35 AND value > 15 AS ok, value < 2 AS err, {_CK}[user_id % 5 + 1] AS failing, value FROM ev
    WHERE event_type IN ('view', 'click', 'purchase')),
  cs AS (SELECT DISTINCT k AS case_id, 'm' || (k % 4) AS mode, CASE WHEN k % 2 = 0 THEN 'approve' ELSE 'reject' END AS want_decision, {_CK}[k % 5 + 1] AS want_check FROM ev),
  pv AS (SELECT config, case_id, count(*) AS samples, count(*) FILTER (ok AND NOT err) AS a, count(*) FILTER (NOT ok AND NOT err) AS r, count(*) FILTER (err) AS e,
    arg_max(CASE WHEN value > 15 THEN '' ELSE failing END, sample) FILTER (NOT ok AND NOT err) AS rej FROM vt GROUP BY ALL),
  oc AS (SELECT config, case_id, mode, want_decision, samples, a, r, want_check, rej, CASE WHEN a * 2 > samples THEN 'approve' WHEN r * 2 > samples THEN 'reject' WHEN e >= a AND e >= r THEN NULL WHEN a >= r THEN 'approve' ELSE 'reject' END AS got
    FROM pv JOIN cs USING (case_id)),
  jo AS (SELECT config, case_id, mode, want_decision, coalesce(got, '') AS got, samples, got IS NULL AS errored, coalesce(got = want_decision, false) AS correct,
    coalesce(want_decision = 'reject' AND got = 'approve', false) AS false_approve, coalesce(want_decision <> 'reject' AND got = 'reject', false) AS false_reject,
    coalesce(got = 'reject' AND want_check = rej, false) AS caught, a > 0 AND r > 0 AS flipped FROM oc)"""
_LV = f"""lv AS (SELECT {Q.rid('l_orderkey')} AS record_id, l_linenumber AS sample, l_quantity > 20 AS approved, CASE WHEN l_tax > 0.07e0 THEN 'timeout' ELSE '' END AS error, l_discount, l_suppkey FROM lineitem)"""
ATT = f"""rr AS (SELECT {Q.rid('l_orderkey')} AS record_id, l_returnflag AS label, CASE WHEN l_quantity < 15 THEN 'skipped' WHEN l_quantity < 46 THEN 'holds' WHEN l_quantity < 49 THEN 'broken' ELSE 'error' END AS status FROM lineitem),
  pl AS (SELECT record_id, label, bool_or(status <> 'skipped') AS ran, bool_and(status IN ('holds', 'skipped')) AS clean FROM rr GROUP BY ALL),
  att AS (SELECT record_id, bool_or(ran) AND bool_and(clean) AS holds, NOT bool_or(ran) AS inconclusive, coalesce(string_agg(label, ',' ORDER BY label) FILTER (ran AND clean), '') AS reproduced_under FROM pl GROUP BY record_id)"""
JUDGED = f"judged AS (SELECT {Q.rid('vec_id')} AS id, CASE WHEN label <> 3 THEN label % 2 = 0 END AS approved FROM embeddings)"
_ADV = f"len(list_filter(signatures, lambda x: regexp_matches(upper({Q.utrim('x')}), '^(GHSA-|CVE-|GO-)'))) > 0"
ROUTES = f"""rt AS (SELECT id, status, source, lang, {content._CAUSE} AS cause, CASE WHEN {_ADV} THEN 'advisory' WHEN lang = 'en' THEN 'proof' ELSE 'prose' END AS cls FROM corpus),
  ro AS (SELECT *, CASE WHEN status = 'quarantined' AND cause THEN cls WHEN status IN ('stale', 'disputed') AND lang = 'en' THEN 'repromotion' WHEN status = 'quarantined' AND lang <> 'en' THEN 'drafting' ELSE 'none' END AS route FROM rt)"""
REPORTS = f"""{LP.EV}, er AS (SELECT *, {Q.rid('event_id + 1000000')} AS report_id, {Q.rid('k * 11')} AS record_id FROM ev WHERE event_type = 'error'),
  rc AS (SELECT record_id, count(*) AS reports FROM er GROUP BY 1)"""
_RUN = f"""b AS (SELECT o_orderkey AS seq, o_orderstatus <> 'P' AS eligible, o_totalprice > 250000 AS promoted FROM orders),
  w AS (SELECT *, coalesce(sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS jb,
    coalesce(sum(CASE WHEN eligible AND promoted THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM b),
  c AS (SELECT min(seq) AS cut FROM w WHERE ab > {GUARDS.max_actions} OR (eligible AND jb >= {GUARDS.max_runs})),
  kept AS (SELECT b.* FROM b, c WHERE cut IS NULL OR seq < cut)"""

SQL = {
    "retrieval_eval": f"""WITH {Q.CORPUS}, {Q.BENCHMARK_QUERIES}, {Q.document_tokens()}, {Q.bm25_ctes('queries')}, {TRUTH_SQL},
      pc AS (SELECT case_id, t.record_id, min(rank) FILTER (top.record_id = t.record_id) AS rank, arg_min(top.record_id, rank) AS first FROM truth t LEFT JOIN top ON query_id = case_id GROUP BY ALL)
      SELECT count(*) AS cases, count(rank) AS found, round(coalesce(count(rank) / nullif(count(*), 0), 0e0), 6) AS recall_at_k, round(coalesce(sum(1e0 / rank) / nullif(count(*), 0), 0e0), 6) AS mrr,
        round(coalesce(count(*) FILTER (first <> record_id) / nullif(count(*), 0), 0e0), 6) AS near_miss_rate FROM pc""",
    "push_eval": f"""WITH {LP.DEC}, c AS (SELECT event_id, trigger, cnt, record_id, CASE WHEN trigger = 'error' THEN event_id % 2 = 0 END AS same FROM dec WHERE channel = 'push'),
      n AS (SELECT count(*) FILTER (trigger = 'prompt') AS negatives, count(*) FILTER (trigger = 'prompt' AND cnt > 0) AS false_injections, count(*) FILTER (trigger = 'error') AS positives,
        count(*) FILTER (trigger = 'error' AND cnt > 0 AND same) AS recalled FROM c)
      SELECT *, round(CASE WHEN negatives = 0 THEN 1e0 ELSE 1 - false_injections / negatives END, 6) AS precision, round(CASE WHEN positives = 0 THEN 1e0 ELSE recalled / positives END, 6) AS recall FROM n""",
    "usage_eval": f"""WITH {LP.DEC}, sv AS (SELECT DISTINCT session, record_id FROM dec WHERE cnt > 0), gd AS (SELECT DISTINCT {LP._HASH('user_id')} AS session, {Q.rid('k')} AS record_id, true AS g FROM ev WHERE event_type = 'purchase'),
      jd AS (SELECT DISTINCT {LP._HASH('user_id')} AS session, {Q.rid('k')} AS record_id, true AS j FROM ev WHERE event_type = 'signup' AND value > 5),
      n AS (SELECT count(DISTINCT session) AS cases, count(*) FILTER (j AND g) AS tp, count(*) FILTER (j AND g IS NULL) AS fp, count(*) FILTER (j IS NULL AND g) AS fn FROM sv LEFT JOIN gd USING (session, record_id) LEFT JOIN jd USING (session, record_id))
      SELECT *, round(CASE WHEN tp + fp = 0 THEN 1e0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1e0 ELSE tp / (tp + fn) END, 6) AS recall FROM n""",
    "judge_outcomes": f"WITH {JUDGE} SELECT * FROM jo",
    "judge_eval": f"""WITH {JUDGE}, n AS (SELECT config, count(*) AS cases, count(*) FILTER (want_decision = 'reject') AS reject_cases, count(*) FILTER (want_decision <> 'reject') AS approve_cases, count(*) FILTER (errored) AS errors,
        count(*) FILTER (false_approve) AS false_approves, count(*) FILTER (false_reject) AS false_rejects, count(*) FILTER (correct) AS correct, count(*) FILTER (want_decision = 'reject' AND caught) AS checks_caught,
        count(*) FILTER (flipped) AS flips, CAST(sum(samples) AS BIGINT) AS judge_calls, count(*) FILTER (want_decision = 'reject' AND errored) AS re FROM jo GROUP BY config),
      r AS (SELECT * EXCLUDE (re), round(coalesce(false_approves / nullif(reject_cases, 0), 0e0), 6) AS false_approve_rate, round(coalesce(false_rejects / nullif(approve_cases, 0), 0e0), 6) AS false_reject_rate,
        round(coalesce(correct / nullif(cases, 0), 0e0), 6) AS accuracy, round(CASE WHEN reject_cases - false_approves - re > 0 THEN checks_caught / (reject_cases - false_approves - re) ELSE 0e0 END, 6) AS check_recall FROM n)
      SELECT *, row_number() OVER (ORDER BY false_approves, false_rejects, errors, accuracy DESC, config) AS place FROM r""",
    "judge_eval_by_mode": f"""WITH {JUDGE} SELECT config, mode, count(*) AS cases, count(*) FILTER (correct) AS correct, count(*) FILTER (false_approve) AS false_approves, count(*) FILTER (false_reject) AS false_rejects,
      count(*) FILTER (errored) AS errors, CAST(list_position(['m3', 'm1', 'm2', 'm0'], mode) AS BIGINT) AS position FROM jo GROUP BY config, mode""",
    "verdict_approved": f"WITH {JUDGE} SELECT sample, ok AS approved FROM vt",
    "arm_eval": """WITH n AS (SELECT count(*) FILTER (l_linestatus <> 'O') AS cases, count(*) FILTER (l_linestatus <> 'O' AND l_returnflag = 'R') AS avoided_off, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS avoided_on,
        CAST(coalesce(sum(l_linenumber) FILTER (l_linestatus <> 'O'), 0) AS BIGINT) AS steps_off, CAST(coalesce(sum(l_linenumber) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS steps_on,
        CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus <> 'O'), 0) AS BIGINT) AS tokens_off, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS tokens_on FROM lineitem)
      SELECT *, round(avoided_off / cases, 6) AS avoidance_off, round(avoided_on / cases, 6) AS avoidance_on FROM n""",
    "prospect_funnel": """WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'ineligible' WHEN o_orderpriority = '5-LOW' THEN 'unsupported' WHEN o_totalprice > 450000 THEN 'leak' WHEN o_totalprice < 50000 THEN 'irrelevant'
        WHEN o_custkey % 10 = 3 THEN 'deps' WHEN o_custkey % 10 = 4 THEN 'control' WHEN o_orderpriority = '1-URGENT' THEN 'off_avoided' ELSE 'model_hard' END AS st, o_orderpriority AS p FROM orders)
      SELECT count(*) AS scanned, count(*) FILTER (st <> 'ineligible') AS eligible, count(*) FILTER (st IN ('off_avoided', 'model_hard')) AS drafted, """
    + ", ".join(f"count(*) FILTER (st = '{x}') AS skipped_{x}" for x in E.FUNNEL)
    + ", count(*) FILTER (st = 'off_avoided') AS off_avoided, count(*) FILTER (st = 'model_hard') AS model_hard, count(*) FILTER (st = 'model_hard' AND p = '2-HIGH') AS card_helped FROM s",
    "latency_stats": """SELECT event_type, count(*) AS calls, count(*) FILTER (value > 15) AS approvals, count(*) FILTER (value <= 15) AS rejections,
      quantile_disc(CAST(round(value * 100) AS BIGINT), 0.5) AS p50_ms, quantile_disc(CAST(round(value * 100) AS BIGINT), 0.95) AS p95_ms FROM events WHERE value >= 1 GROUP BY event_type""",
    "majority_vote": f"""WITH {_LV}, v AS (SELECT record_id, sample, bool_and(approved) AS approved, max(error) AS error, max(l_discount) AS disc FROM lv GROUP BY ALL),
      m AS (SELECT record_id, CASE WHEN error <> '' AND disc <= 0.05e0 THEN disc > 0.02e0 ELSE approved END AS approved, error <> '' AND disc > 0.05e0 AS err FROM v),
      n AS (SELECT record_id, count(*) AS votes, count(*) FILTER (approved AND NOT err) AS approvals, count(*) FILTER (err) AS errors FROM m GROUP BY record_id)
      SELECT *, CASE WHEN errors = 0 THEN CAST(approvals * 2 > votes AS VARCHAR) ELSE 'none' END AS approved FROM n""",
    "panel_vote": f"""WITH {_LV}, m AS (SELECT record_id, ['Ash', 'birch', 'cedar', 'elm'][l_suppkey % 4 + 1] AS fam, sample, approved AND error = '' AS ok FROM lv),
      n AS (SELECT record_id, count(*) AS members, count(DISTINCT fam) AS families, bool_and(ok) AS ok, string_agg(fam || '-' || sample, '+' ORDER BY fam || '-' || sample) AS models FROM m GROUP BY record_id)
      SELECT record_id, members, families, members >= 2 AND families = members AND ok AS approved, models FROM n""",
    "attestation_rollup": f"WITH {ATT} SELECT * FROM att",
    "promote": f"""WITH {Q.CORPUS}, {ROUTES}, {ATT}, {JUDGED},
      j AS (SELECT ro.*, holds, inconclusive, approved, judged.id IS NOT NULL AS was FROM ro LEFT JOIN att ON att.record_id = ro.id LEFT JOIN judged ON judged.id = ro.id),
      h AS (SELECT *, route IN ('advisory', 'prose', 'proof') AS el, CASE WHEN route IN ('advisory', 'prose') AND source = 'src1' THEN 'born_stale' WHEN route = 'proof' AND holds IS NULL THEN 'no_attestation'
        WHEN route = 'proof' AND (NOT holds OR inconclusive) THEN 'attestation_does_not_hold' WHEN NOT was OR approved IS NULL THEN 'no_verdict' WHEN NOT approved THEN 'not_approved' END AS held FROM j),
      o AS (SELECT *, CASE WHEN NOT el THEN 'ineligible' WHEN held IS NULL THEN 'promoted' WHEN held = 'no_verdict' AND route <> 'proof' THEN 'deferred' ELSE 'held' END AS outcome FROM h)
      SELECT id, route, outcome, CASE WHEN el THEN coalesce(held, '') WHEN route NOT IN ('none', 'drafting') THEN '' WHEN NOT cause THEN 'no_substantive_root_cause' WHEN status <> 'quarantined' THEN 'not_quarantined' ELSE '' END AS reason,
        status AS from_status, CASE WHEN outcome = 'promoted' THEN 'validated' ELSE status END AS to_status, CASE WHEN outcome = 'promoted' THEN '{NOW}' ELSE '' END AS validated_at, CASE WHEN outcome = 'promoted' THEN 'ash+elm' ELSE '' END AS judge_models FROM o""",
    "repromote": f"""WITH {Q.CORPUS}, {ROUTES}, {ATT}, {JUDGED},
      j AS (SELECT ro.*, holds, inconclusive, approved, judged.id IS NOT NULL AS was FROM ro LEFT JOIN att ON att.record_id = ro.id LEFT JOIN judged ON judged.id = ro.id),
      h AS (SELECT *, route = 'repromotion' AS el, CASE WHEN holds IS NULL THEN 'no_attestation' WHEN NOT holds OR inconclusive THEN 'attestation_does_not_hold' WHEN NOT was OR approved IS NULL THEN 'no_verdict' WHEN NOT approved THEN 'not_approved' END AS held FROM j),
      o AS (SELECT *, CASE WHEN NOT el THEN 'ineligible' WHEN held IS NULL THEN 'promoted' ELSE 'held' END AS outcome FROM h)
      SELECT id, outcome, CASE WHEN el THEN coalesce(held, '') ELSE 'not_repromotable' END AS reason, status AS from_status, CASE WHEN outcome = 'promoted' THEN 'validated' ELSE status END AS to_status,
        CASE WHEN outcome = 'promoted' THEN '{NOW}' ELSE '' END AS validated_at, outcome = 'promoted' AS clears_demotion FROM o""",
    "dispute_join": f"""WITH {Q.CORPUS}, {REPORTS} SELECT report_id, record_id, coalesce(status, 'orphan') AS record_status, CASE WHEN status IS NULL THEN 0 ELSE reports END AS reports
      FROM er JOIN rc USING (record_id) LEFT JOIN corpus USING (record_id)""",
    "adapt": f"""WITH {Q.CORPUS}, {REPORTS}, j AS (SELECT report_id, record_id, status, reports, (value >= 5 AND value >= 30) OR (value >= 12 AND value > 25) AS proven, value < 12 AS inc, CASE WHEN value > 26 THEN value < 40 END AS approved
        FROM er JOIN rc USING (record_id) LEFT JOIN corpus USING (record_id)),
      a AS (SELECT *, CASE WHEN status IS NULL THEN 'orphan' WHEN status <> 'validated' THEN 'none' WHEN proven AND coalesce(approved, false) THEN 'demote' WHEN proven OR inc THEN 'none' WHEN reports >= 3 THEN 'dispute' ELSE 'none' END AS act FROM j),
      f AS (SELECT *, coalesce(report_id > min(report_id) FILTER (act IN ('demote', 'dispute')) OVER (PARTITION BY record_id), false) AS late,
        arg_min(act, report_id) FILTER (act IN ('demote', 'dispute')) OVER (PARTITION BY record_id) AS did FROM a),
      g AS (SELECT *, CASE WHEN late THEN 'none' ELSE act END AS action FROM f)
      SELECT report_id, record_id, action, CASE WHEN status IS NULL THEN 'unknown_record' WHEN status <> 'validated' OR late THEN 'not_validated' WHEN proven AND approved IS NULL THEN 'no_verdict' WHEN proven AND NOT approved THEN 'not_approved' WHEN proven THEN 'reproduced'
        WHEN inc THEN 'inconclusive' WHEN reports >= 3 THEN 'corroborated' ELSE 'below_threshold' END AS reason,
        CASE CASE WHEN late THEN did ELSE action END WHEN 'demote' THEN 'stale' WHEN 'dispute' THEN 'disputed' ELSE coalesce(status, '') END AS to_status,
        CASE WHEN action = 'demote' THEN '{NOW}' ELSE '' END AS valid_until FROM g""",
    "guarded_batch": f"""WITH {_RUN}, n AS (SELECT count(*) AS processed, count(*) FILTER (eligible) AS judged, count(*) FILTER (eligible AND promoted) AS promoted FROM kept)
      SELECT processed, judged, promoted, round(coalesce(promoted / nullif(judged, 0), 0e0), 6) AS rate, false AS paused, promoted > {GUARDS.max_actions} AS count_anomaly,
        judged >= {GUARDS.min_sample} AND promoted / nullif(judged, 0) > {GUARDS.max_action_rate}e0 AS rate_anomaly, false AS capped FROM n""",
    "guarded_prefix": f"WITH {_RUN} SELECT seq, eligible, promoted FROM kept",
    "hold_cooldown": f"""WITH a AS (SELECT {Q.rid('o_custkey')} AS id, CASE o_orderstatus WHEN 'F' THEN 'held' ELSE 'promoted' END AS outcome, o_orderdate AS od FROM orders WHERE o_orderstatus <> 'P'),
      l AS (SELECT id, od, outcome FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY od DESC, outcome DESC) AS n FROM a) WHERE n = 1),
      h AS (SELECT id, od FROM l WHERE outcome = 'held' AND od > TIMESTAMP '2001-06-01' - INTERVAL 400 DAY)
      SELECT {Q.rid('c_custkey')} AS id, 'kept' AS part, '' AS held_at FROM customer WHERE {Q.rid('c_custkey')} NOT IN (SELECT id FROM h) UNION ALL SELECT id, 'held', strftime(od, '%Y-%m-%d %H:%M:%S') FROM h""",
    "run_counts": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_id, o_orderpriority AS stage, count(*) FILTER (o_orderstatus = 'O') AS promoted, count(*) FILTER (o_orderstatus = 'F') AS held, count(*) FILTER (o_orderstatus = 'P') AS ineligible FROM orders GROUP BY ALL""",
    "liveness_alarm": """WITH r AS (SELECT o_custkey AS pipeline, o_totalprice > 300000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders),
      n AS (SELECT pipeline, count(*) AS runs, count(*) FILTER (p) AS promoted FROM r WHERE n <= 3 GROUP BY pipeline), b AS (SELECT o_custkey AS pipeline, count(*) AS eligible FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
      SELECT pipeline, runs, promoted, coalesce(eligible, 0) AS eligible, runs >= 3 AND promoted = 0 AND coalesce(eligible, 0) > 0 AS alarm FROM n LEFT JOIN b USING (pipeline)""",
    "growth_watch": f"""WITH s AS (SELECT user_id AS corpus, ts, CAST(floor(value) AS BIGINT) AS v FROM events),
      g AS (SELECT corpus, arg_max(v, (ts, v)) AS validated, min(ts) FILTER (v = m AND v > 0) AS last_growth FROM (SELECT *, max(v) OVER (PARTITION BY corpus) AS m FROM s) GROUP BY corpus),
      h AS (SELECT corpus, validated, last_growth, CAST(floor(epoch(TIMESTAMP '{RUN_STAMP}' - last_growth) / 3600) AS BIGINT) AS flat_hours FROM g)
      SELECT corpus, validated, strftime(last_growth, '%Y-%m-%d %H:%M:%S') AS last_growth, flat_hours, validated <= 0 OR coalesce(flat_hours >= 288, false) AS alarm,
        CASE WHEN validated <= 0 THEN 'zero_count' WHEN flat_hours >= 288 THEN 'not_growing' ELSE '' END AS reason FROM h""",
    "stall_watch": """WITH i AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failure' ELSE 'open' END AS state, CAST(floor(epoch(TIMESTAMP '1998-01-01' - o_orderdate) / 60) AS BIGINT) AS age_min FROM orders)
      SELECT * FROM i WHERE age_min >= 120 OR state = 'failure'""",
}
