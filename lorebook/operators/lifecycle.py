"""Lifecycle decisions: verdicts, votes, promotion, demotion, guardrails, watches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import range_offsets, sorted_places
from ..functions.stats import count_if, ratio
from .advisories import defects_column, is_blocking_flag, staleness
from .records import route_records

# Canonical checks of a verdict, dispute threshold, alarm windows.
CHECKS = ("meaning", "scope", "usefulness", "license", "poison")
DISPUTE_THRESHOLD = 3
HOLD_DAYS = 7
LIVENESS_RUNS, GROWTH_HOURS, STALL_MINUTES = 3, 24, 120


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def approved_column() -> Column:
    """Clean pass: approve, every canonical check present, and no failing check at all."""
    checks = F.col("checks")
    names = F.transform(checks, lambda c: c["check"])
    present = F.size(F.array_except(F.array(*[F.lit(c) for c in CHECKS]), names)) == 0
    return F.coalesce(
        (F.col("decision") == "approve") & F.forall(checks, lambda c: F.coalesce(c["pass"], F.lit(False))) & present,
        F.lit(False),
    )


def verdict_approved(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("approved", approved_column())


def majority_vote(votes: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """(record_id, votes, approvals, errors, approved): strict majority; null when any vote errored.

    ``votes`` is (record_id, sample, approved, error).  Where the primary errored, the secondary's
    verdict for the same sample is used instead.
    """
    failed = lambda c: F.coalesce(c, F.lit("")) != ""
    if secondary is not None:
        s = secondary.select("record_id", "sample", F.col("approved").alias("_a"), F.col("error").alias("_e"))
        use = failed(F.col("error")) & F.col("_a").isNotNull() & ~failed(F.col("_e"))
        votes = votes.join(s, ["record_id", "sample"], "left").select(
            "record_id", "sample",
            F.when(use, F.col("_a")).otherwise(F.col("approved")).alias("approved"),
            F.when(use, F.lit("")).otherwise(F.col("error")).alias("error"),
        )
    err = failed(F.col("error"))
    out = votes.groupBy("record_id").agg(
        F.count("*").alias("votes"),
        count_if(F.coalesce("approved", F.lit(False)) & ~err).alias("approvals"),
        count_if(err).alias("errors"),
    )
    return out.withColumn("approved", F.when(F.col("errors") == 0, F.col("approvals") * 2 > F.col("votes")))


def model_family(model: Column) -> Column:
    """Leading letters of the lower-cased model id."""
    return F.regexp_extract(F.lower(F.trim(model)), r"^([a-z]+)", 1)


def panel_vote(verdicts: DataFrame) -> DataFrame:
    """(record_id, members, families, approved, models): unanimous, two or more members, distinct families.

    ``verdicts`` is (record_id, model, approved, error).
    """
    err = F.coalesce("error", F.lit("")) != ""
    family = F.nullif(model_family(F.col("model")), F.lit(""))
    out = verdicts.groupBy("record_id").agg(
        F.count("*").alias("members"),
        F.countDistinct(family).alias("families"),
        F.bool_and(F.coalesce("approved", F.lit(False)) & ~err).alias("all_ok"),
        F.array_join(F.array_sort(F.collect_list("model")), "+").alias("models"),
    )
    diverse = (F.col("members") >= 2) & (F.col("families") == F.col("members"))
    return out.select("record_id", "members", "families", (diverse & F.col("all_ok")).alias("approved"), "models")


def attestation_rollup(results: DataFrame) -> DataFrame:
    """(record_id, holds, inconclusive, reproduced_under) from (record_id, label, path, kind, status).

    A record holds when something ran and nothing broke; all skipped is inconclusive; a label
    reproduces when it ran and its whole set held.
    """
    ran = F.col("status") != "skipped"
    per_label = results.groupBy("record_id", "label").agg(
        F.bool_or(ran).alias("ran"),
        F.bool_and((F.col("status") == "holds") | ~ran).alias("clean"),
    )
    return per_label.groupBy("record_id").agg(
        (F.bool_or("ran") & F.bool_and("clean")).alias("holds"),
        (~F.bool_or("ran")).alias("inconclusive"),
        F.array_sort(F.collect_list(F.when(F.col("ran") & F.col("clean"), F.col("label")))).alias("reproduced_under"),
    )


def promote(records: DataFrame, attestations: DataFrame, verdicts: DataFrame, now: str, cycles: DataFrame | None = None) -> DataFrame:
    """(id, route, outcome, reason, from_status, to_status, validated_at, judge_models).

    ``attestations`` is the output of :func:`attestation_rollup`; ``verdicts`` is (record_id,
    approved, models), null ``approved`` meaning the judge gave no verdict.  Cheap checks come
    first: route, end of life, blocking defects, attestation, verdict.
    """
    spark = records.sparkSession
    cycles = cycles if cycles is not None else spark.createDataFrame([], "product string, cycle string, eol string")
    routes = route_records(records)
    stale = staleness(records, cycles, now, validated_only=False).select("id", F.lit(True).alias("stale"))
    facts = records.select(
        "id", "status", F.exists(defects_column(), is_blocking_flag).alias("blocked")
    )
    att = attestations.select(F.col("record_id").alias("id"), "holds", "inconclusive")
    ver = verdicts.select(F.col("record_id").alias("id"), "approved", "models", F.lit(True).alias("judged"))
    j = facts.join(routes, "id").join(stale, "id", "left").join(att, "id", "left").join(ver, "id", "left")
    route = F.col("route")
    panel = route.isin("advisory", "prose")
    proof = route == "proof"
    held = (
        F.when(panel & F.coalesce("stale", F.lit(False)), "born_stale")
        .when((route == "advisory") & F.col("blocked"), "consistency_defect")
        .when(proof & F.col("holds").isNull(), "no_attestation")
        .when(proof & (~F.col("holds") | F.col("inconclusive")), "attestation_does_not_hold")
        .when(F.col("judged").isNull() | F.col("approved").isNull(), "no_verdict")
        .when(~F.col("approved"), "not_approved")
    )
    eligible = route.isin("advisory", "prose", "proof")
    outcome = (
        F.when(~eligible, "ineligible")
        .when(F.col("held").isNull(), "promoted")
        .when((F.col("held") == "no_verdict") & panel, "deferred")
        .otherwise("held")
    )
    promoted = F.col("outcome") == "promoted"
    return (
        j.withColumn("held", held)
        .withColumn("outcome", outcome)
        .select(
            "id", "route", "outcome",
            F.when(~eligible, F.col("reason")).otherwise(F.coalesce("held", F.lit(""))).alias("reason"),
            F.col("status").alias("from_status"),
            F.when(promoted, "validated").otherwise(F.col("status")).alias("to_status"),
            F.when(promoted, F.lit(now)).alias("validated_at"),
            F.when(promoted, F.col("models")).alias("judge_models"),
        )
    )


def repromote(records: DataFrame, attestations: DataFrame, verdicts: DataFrame, now: str) -> DataFrame:
    """Like :func:`promote` for demoted records; a promoted row also clears its window and demotion."""
    routes = route_records(records)
    att = attestations.select(F.col("record_id").alias("id"), "holds", "inconclusive")
    ver = verdicts.select(F.col("record_id").alias("id"), "approved", "models", F.lit(True).alias("judged"))
    j = records.select("id", "status").join(routes, "id").join(att, "id", "left").join(ver, "id", "left")
    held = (
        F.when(F.col("holds").isNull(), "no_attestation")
        .when(~F.col("holds") | F.col("inconclusive"), "attestation_does_not_hold")
        .when(F.col("judged").isNull() | F.col("approved").isNull(), "no_verdict")
        .when(~F.col("approved"), "not_approved")
    )
    eligible = F.col("route") == "repromotion"
    ok = F.col("outcome") == "promoted"
    return (
        j.withColumn("held", held)
        .withColumn("outcome", F.when(~eligible, "ineligible").when(F.col("held").isNull(), "promoted").otherwise("held"))
        .select(
            "id", "outcome",
            F.when(eligible, F.coalesce("held", F.lit(""))).otherwise("not_repromotable").alias("reason"),
            F.col("status").alias("from_status"),
            F.when(ok, "validated").otherwise(F.col("status")).alias("to_status"),
            F.when(ok, F.lit(now)).alias("validated_at"),
            ok.alias("clears_demotion"),
        )
    )


def dispute_join(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, orphans): quarantined outcome reports with the record they dispute and its report count.

    The record count side is aggregated before the join, so a record with a third of all
    reports is one row on its side.
    """
    reports = records.where((F.col("status") == "quarantined") & F.col("provenance.disputes").isNotNull()).select(
        F.col("id").alias("report_id"), F.col("provenance.disputes").alias("record_id")
    )
    counts = reports.groupBy("record_id").agg(F.count("*").alias("reports"))
    targets = records.select(F.col("id").alias("record_id"), F.col("status").alias("record_status"))
    known = targets.join(counts, "record_id")
    joined = reports.join(known, "record_id")
    return joined, reports.join(targets, "record_id", "left_anti")


def adapt(
    records: DataFrame, evidence: DataFrame, verdicts: DataFrame, now: str, threshold: int = DISPUTE_THRESHOLD
) -> DataFrame:
    """(report_id, record_id, action, reason, to_status, valid_until) for every outcome report.

    ``evidence`` is (report_id, original_holds, original_inconclusive, counter_holds,
    counter_inconclusive); ``verdicts`` is (report_id, approved).  A record's reports are taken in
    the order of their ids.  The first that acts changes its status, so the later ones find it
    not validated and do nothing.
    """
    joined, orphans = dispute_join(records)
    j = joined.join(evidence, "report_id", "left").join(verdicts.select("report_id", "approved"), "report_id", "left")
    inconclusive = lambda c: F.coalesce(c, F.lit(True))
    broke = ~inconclusive("original_inconclusive") & ~F.coalesce("original_holds", F.lit(False))
    reproduced = ~inconclusive("counter_inconclusive") & F.coalesce("counter_holds", F.lit(False))
    proven = broke | reproduced
    validated = F.col("record_status") == "validated"
    action = (
        F.when(~validated, "none")
        .when(proven & F.coalesce("approved", F.lit(False)), "demote")
        .when(proven | inconclusive("counter_inconclusive"), "none")
        .when(F.col("reports") >= threshold, "dispute")
        .otherwise("none")
    )
    reason = (
        F.when(~validated, "not_validated")
        .when(proven & F.col("approved").isNull(), "no_verdict")
        .when(proven & ~F.col("approved"), "not_approved")
        .when(proven, "reproduced")
        .when(inconclusive("counter_inconclusive"), "inconclusive")
        .when(F.col("reports") >= threshold, "corroborated")
        .otherwise("below_threshold")
    )
    act = F.col("action")
    judged = j.withColumn("action", action).withColumn("reason", reason).select(
        "report_id", "record_id", "action", "reason",
        F.when(act == "demote", "stale").when(act == "dispute", "disputed").otherwise(F.col("record_status")).alias("to_status"),
    )
    first = judged.where(act != "none").groupBy("record_id").agg(
        F.min("report_id").alias("_first"), F.min_by("to_status", "report_id").alias("_changed")
    )
    late = F.coalesce(F.col("report_id") > F.col("_first"), F.lit(False))
    decided = judged.join(first, "record_id", "left").select(
        "report_id", "record_id", F.when(late, "none").otherwise(act).alias("action"),
        F.when(late, "not_validated").otherwise(F.col("reason")).alias("reason"),
        F.when(late, F.col("_changed")).otherwise(F.col("to_status")).alias("to_status"),
        F.when(~late & (act == "demote"), F.lit(now)).alias("valid_until"),
    )
    null = F.lit(None).cast("string")
    lost = orphans.select("report_id", "record_id", F.lit("orphan").alias("action"), F.lit("unknown_record").alias("reason"), null.alias("to_status"), null.alias("valid_until"))
    return decided.unionByName(lost)


@dataclass(frozen=True)
class Guardrails:
    """Limits of one run; 0 turns a limit off."""

    max_actions: int = 0
    max_promotions: int = 0
    max_action_rate: float = 0.0
    min_sample: int = 0
    max_runs: int = 0
    paused: bool = False


def guarded_batch(decisions: DataFrame, g: Guardrails, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(processed, summary): the prefix of decisions the guardrails let through.

    ``decisions`` is (seq, ..., eligible, promoted).  Running sums are distributed prefix counts
    of promotions and judged records; the cut is where the first limit is reached.
    """
    if g.paused:
        decisions = decisions.where(F.lit(False))
    d = decisions.withColumn("_judged", F.col("eligible").cast("bigint")).withColumn(
        "_acted", (F.col("eligible") & F.col("promoted")).cast("bigint")
    )
    running = _running_sums(d, order_col, {"_judged": "judged_before", "_acted": "acted_before"})
    acted, judged = F.col("acted_before"), F.col("judged_before")
    stop = F.lit(False)
    if g.max_promotions > 0:
        stop = stop | (acted >= g.max_promotions)
    elif g.max_actions > 0:
        stop = stop | (acted > g.max_actions)
    if g.max_runs > 0:
        stop = stop | (F.col("eligible") & (judged >= g.max_runs))
    # Each condition is monotone along the order, except a budget stop, which happens at the
    # first eligible row; everything from the first stopping row on is cut.
    cut = running.where(stop).agg(F.min(order_col).alias("cut")).scalar()
    kept = running.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(order_col) < F.col("_cut")))
    processed = kept.drop("_cut", "judged_before", "acted_before", "_judged", "_acted")
    sums = kept.agg(
        F.count("*").alias("processed"),
        F.coalesce(F.sum("_judged"), F.lit(0)).alias("judged"),
        F.coalesce(F.sum("_acted"), F.lit(0)).alias("promoted"),
    )
    count_anomaly = F.lit(g.max_promotions <= 0 and g.max_actions > 0) & (F.col("promoted") > g.max_actions)
    rate = ratio(F.col("promoted"), F.col("judged"))
    rate_anomaly = F.lit(g.max_action_rate > 0) & (F.col("judged") > 0) & (F.col("judged") >= g.min_sample) & (rate > g.max_action_rate)
    summary = sums.select(
        "processed", "judged", "promoted", rate.alias("rate"),
        F.lit(g.paused).alias("paused"),
        count_anomaly.alias("count_anomaly"), rate_anomaly.alias("rate_anomaly"),
        (F.lit(g.max_promotions > 0) & (F.col("promoted") >= max(g.max_promotions, 1))).alias("capped"),
    )
    return processed, summary


def _running_sums(df: DataFrame, order_col: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums along a unique order: sums inside sorted ranges plus those of the ranges before."""
    placed = sorted_places(df, order_col)
    offsets = range_offsets(placed, {f"_o{c}": F.sum(c) for c in sums})
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l{c}") for c in sums])
    out = local.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(f"_l{c}") + F.col(f"_o{c}")).alias(name) for c, name in sums.items()])


def hold_cooldown(records: DataFrame, actions: DataFrame, now: str, days: int = HOLD_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, ledger): records not held within ``days``; ledger (id, held_at) without lapsed holds.

    ``actions`` is (id, outcome, at).  Per record the latest held / promoted action counts: held
    starts the cooldown, promoted clears it; other outcomes leave it alone.
    """
    last = (
        actions.where(F.col("outcome").isin("held", "promoted"))
        .groupBy("id").agg(F.max(F.struct("at", "outcome")).alias("a"))
        .select("id", "a.at", "a.outcome")
    )
    ledger = last.where(
        (F.col("outcome") == "held")
        & (_seconds(F.lit(now)) - _seconds(F.col("at")) < days * 86400)
    ).select("id", F.col("at").alias("held_at"))
    if days <= 0:
        return records, ledger.where(F.lit(False))
    return records.join(ledger.select("id"), "id", "left_anti"), ledger


def run_counts(actions: DataFrame, outcomes: Sequence[str] = ("promoted", "held", "ineligible", "deferred", "demoted", "disputed", "orphan")) -> DataFrame:
    """(run_id, stage, <outcome> ...): actions per run and outcome."""
    return actions.groupBy("run_id", "stage").agg(*[count_if(F.col("outcome") == o).alias(o) for o in outcomes])


def liveness_alarm(runs: DataFrame, backlog: DataFrame, k: int = LIVENESS_RUNS) -> DataFrame:
    """(pipeline, runs, promoted, eligible, alarm): the last k runs promoted nothing although work waits.

    ``runs`` is (pipeline, run_id, promoted), latest run id last; ``backlog`` is (pipeline, eligible).
    """
    w = Window.partitionBy("pipeline").orderBy(F.col("run_id").desc())
    last = runs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    sums = last.groupBy("pipeline").agg(F.count("*").alias("runs"), F.sum("promoted").alias("promoted"))
    eligible = F.coalesce("eligible", F.lit(0).cast("bigint"))
    alarm = (F.col("runs") >= k) & (F.col("promoted") == 0) & (eligible > 0)
    return sums.join(backlog, "pipeline", "left").select("pipeline", "runs", "promoted", eligible.alias("eligible"), alarm.alias("alarm"))


def growth_watch(snapshots: DataFrame, now: str, hours: int = GROWTH_HOURS) -> DataFrame:
    """(corpus, validated, last_growth, flat_hours, alarm, reason) from (corpus, ts, validated).

    A snapshot grows the corpus when it exceeds every earlier one, so the last growth point is
    the earliest time of the overall maximum: one combinable aggregate, no per-corpus sort.
    A count of zero (or none) is suspect: it alarms and is no growth point.
    """
    point = F.struct((-F.col("validated")).alias("neg"), F.col("ts").alias("ts"))
    peak = snapshots.withColumn("validated", F.coalesce("validated", F.lit(0))).groupBy("corpus").agg(
        F.min(F.when(F.col("validated") > 0, point)).alias("p"),
        F.max(F.struct("ts", "validated")).alias("last"),
    )
    flat = F.floor((_seconds(F.lit(now)) - _seconds(F.col("p.ts"))) / 3600)
    return peak.select(
        "corpus", F.col("last.validated").alias("validated"), F.col("p.ts").alias("last_growth"), flat.alias("flat_hours"),
    ).withColumn(
        "reason", F.when(F.col("validated") <= 0, "zero_count").when(F.col("flat_hours") >= hours, "not_growing").otherwise("")
    ).withColumn("alarm", F.col("reason") != "")


def stall_watch(items: DataFrame, now: str, minutes: int = STALL_MINUTES) -> DataFrame:
    """Open items (item_id, opened_at, state) at least ``minutes`` old, or failed."""
    age = F.floor((_seconds(F.lit(now)) - _seconds(F.col("opened_at"))) / 60)
    return items.withColumn("age_min", age).where((F.col("age_min") >= minutes) | (F.col("state") == "failure"))
