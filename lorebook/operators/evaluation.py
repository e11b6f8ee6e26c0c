"""Evaluation jobs: retrieval, push, usage and judge quality, arms, funnels, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selection import nearest_ranks
from ..functions.stats import count_if, ratio


def retrieval_eval(cases: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """One row (cases, found, recall_at_k, mrr, near_miss_rate).

    ``cases`` is (case_id, record_id, ...), ``hits`` is (case_id, rank, record_id).  A near miss
    is a case whose top hit is another record.
    """
    top = hits.where(F.col("rank") <= k).select("case_id", "rank", F.col("record_id").alias("hit"))
    per_case = (
        cases.select("case_id", "record_id").join(top, "case_id", "left")
        .groupBy("case_id", "record_id")
        .agg(
            F.min(F.when(F.col("hit") == F.col("record_id"), F.col("rank"))).alias("rank"),
            F.min_by("hit", "rank").alias("first"),
        )
    )
    n = F.count("*")
    found = count_if(F.col("rank").isNotNull())
    return per_case.agg(
        n.alias("cases"),
        found.alias("found"),
        ratio(found, n).alias("recall_at_k"),
        ratio(F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)), n).alias("mrr"),
        ratio(count_if(F.col("first") != F.col("record_id")), n).alias("near_miss_rate"),
    )


def push_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case (case_id, expect_id, served, verdict): clean, leak, recalled or miss."""
    lists = hits.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda h: h["record_id"]).alias("served")
    )
    served = F.coalesce("served", F.array().cast("array<string>"))
    expect = F.coalesce("expect_id", F.lit(""))
    verdict = (
        F.when((expect == "") & (F.size(served) == 0), "clean")
        .when(expect == "", "leak")
        .when(F.array_contains(served, expect), "recalled")
        .otherwise("miss")
    )
    return cases.join(lists, "case_id", "left").select("case_id", expect.alias("expect_id"), served.alias("served"), verdict.alias("verdict"))


def push_eval(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row; precision and recall are 1 when there is nothing to judge."""
    v = F.col("verdict")
    leaks, misses = count_if(v == "leak"), count_if(v == "miss")
    negatives, positives = count_if(v.isin("clean", "leak")), count_if(v.isin("recalled", "miss"))
    return push_cases(cases, hits).agg(
        negatives.alias("negatives"),
        leaks.alias("false_injections"),
        positives.alias("positives"),
        (positives - misses).alias("recalled"),
        ratio(negatives - leaks, negatives, 1.0).alias("precision"),
        ratio(positives - misses, positives, 1.0).alias("recall"),
    )


def usage_label_errors(labels: DataFrame) -> DataFrame:
    """Label rows that break their contract: empty fields or a used card that was not served."""
    extra = F.array_except(F.coalesce("used", F.array().cast("array<string>")), "served")
    problem = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty_name")
        .when(F.coalesce(F.size("served"), F.lit(0)) <= 0, "empty_served")
        .when(F.size(extra) > 0, "used_not_served")
    )
    return labels.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def usage_eval(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row (cases, tp, fp, fn, precision, recall) restricted to served cards.

    ``labels`` is (name, served[], used[]); ``verdicts`` is (name, record_id, used).
    """
    cards = lambda c: labels.select("name", F.explode(c).alias("record_id")).distinct()
    wanted = cards("used").withColumn("gold", F.lit(True))
    gold = cards("served").join(wanted, ["name", "record_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    judged = verdicts.where("used").select("name", "record_id", F.lit(True).alias("judged")).distinct()
    j = F.coalesce("judged", F.lit(False))
    g = F.col("gold")
    tp, fp, fn = count_if(j & g), count_if(j & ~g), count_if(~j & g)
    counts = gold.join(judged, ["name", "record_id"], "left").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    cases = labels.agg(F.count("*").alias("cases")).scalar()
    return counts.select(
        cases.alias("cases"),
        "tp", "fp", "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0).alias("recall"),
    )


def case_outcomes(cases: DataFrame, votes: DataFrame, approved: Column | None = None) -> DataFrame:
    """Per (config, case_id): the reduced decision of repeated votes against the wanted one.

    ``cases`` is (case_id, mode, want_decision, want_checks[]); ``votes`` is (config, case_id,
    sample, decision, checks[{check, pass}], error).  A clear majority wins; errors that are at
    least as many as either side give no verdict; a tie counts as an approval.
    """
    from .lifecycle import approved_column

    ok = approved_column() if approved is None else approved
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    failing = F.transform(F.filter("checks", lambda c: ~c["pass"]), lambda c: c["check"])
    per = (
        votes.withColumn("_err", failed)
        .withColumn("_ok", ~F.col("_err") & ok)
        .groupBy("config", "case_id")
        .agg(
            F.count("*").alias("samples"),
            count_if(F.col("_ok")).alias("approvals"),
            count_if(~F.col("_ok") & ~F.col("_err")).alias("rejects"),
            count_if(F.col("_err")).alias("error_samples"),
            F.max_by(F.when(~F.col("_ok") & ~F.col("_err"), failing), F.when(~F.col("_ok") & ~F.col("_err"), F.col("sample"))).alias("reject_checks"),
        )
    )
    a, r, e, n = (F.col(c) for c in ("approvals", "rejects", "error_samples", "samples"))
    got = (
        F.when(a * 2 > n, "approve").when(r * 2 > n, "reject").when((e >= a) & (e >= r), F.lit(None).cast("string"))
        .when(a >= r, "approve").otherwise("reject")
    )
    joined = cases.join(per, "case_id").withColumn("got", got)
    want = F.col("want_decision")
    caught = (F.col("got") == "reject") & F.coalesce(F.arrays_overlap("want_checks", "reject_checks"), F.lit(False))
    return joined.select(
        "config", "case_id", "mode", "want_decision", "got", "samples",
        F.col("got").isNull().alias("errored"),
        F.coalesce(F.col("got") == want, F.lit(False)).alias("correct"),
        F.coalesce((want == "reject") & (F.col("got") == "approve"), F.lit(False)).alias("false_approve"),
        F.coalesce((want != "reject") & (F.col("got") == "reject"), F.lit(False)).alias("false_reject"),
        F.coalesce(caught, F.lit(False)).alias("caught"),
        ((a > 0) & (r > 0)).alias("flipped"),
    )


def judge_eval(outcomes: DataFrame) -> DataFrame:
    """One row per judge config, best first (``place``): fewest false approvals decide."""
    reject = F.col("want_decision") == "reject"
    sums = outcomes.groupBy("config").agg(
        F.count("*").alias("cases"),
        count_if(reject).alias("reject_cases"),
        count_if(~reject).alias("approve_cases"),
        count_if(F.col("errored")).alias("errors"),
        count_if(F.col("false_approve")).alias("false_approves"),
        count_if(F.col("false_reject")).alias("false_rejects"),
        count_if(F.col("correct")).alias("correct"),
        count_if(reject & F.col("caught")).alias("checks_caught"),
        count_if(F.col("flipped")).alias("flips"),
        count_if(reject & F.col("errored")).alias("_reject_errors"),
        F.sum("samples").alias("judge_calls"),
    )
    c = F.col
    rated = sums.select(
        *[x for x in sums.columns if not x.startswith("_")],
        ratio(c("false_approves"), c("reject_cases")).alias("false_approve_rate"),
        ratio(c("false_rejects"), c("approve_cases")).alias("false_reject_rate"),
        ratio(c("correct"), c("cases")).alias("accuracy"),
        ratio(c("checks_caught"), c("reject_cases") - c("false_approves") - c("_reject_errors")).alias("check_recall"),
    )
    # One row per configuration, so a single ordered window is small by construction.
    w = Window.orderBy("false_approves", "false_rejects", "errors", F.col("accuracy").desc(), "config")
    return rated.withColumn("place", F.row_number().over(w))


def judge_eval_by_mode(outcomes: DataFrame, modes: Sequence[str] = ()) -> DataFrame:
    """(config, mode, cases, correct, false_approves, false_rejects, errors, position) per failure mode."""
    position = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")) if modes else F.lit(0)
    return outcomes.groupBy("config", "mode").agg(
        F.count("*").alias("cases"),
        count_if(F.col("correct")).alias("correct"),
        count_if(F.col("false_approve")).alias("false_approves"),
        count_if(F.col("false_reject")).alias("false_rejects"),
        count_if(F.col("errored")).alias("errors"),
    ).withColumn("position", position.cast("bigint"))


def arm_eval(outcomes: DataFrame) -> DataFrame:
    """One row comparing runs without and with the card: avoidance, steps, tokens.

    ``outcomes`` is (trap_id, memory_on, avoided, steps, tokens), one row per case and arm.
    """
    on = F.col("memory_on")
    sums = outcomes.agg(
        count_if(~on).alias("cases"),
        count_if(~on & F.col("avoided")).alias("avoided_off"),
        count_if(on & F.col("avoided")).alias("avoided_on"),
        *[
            F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint").alias(f"{c}_{arm}")
            for c in ("steps", "tokens")
            for arm, cond in (("off", ~on), ("on", on))
        ],
    )
    return sums.withColumn("avoidance_off", ratio(F.col("avoided_off"), F.col("cases"))).withColumn(
        "avoidance_on", ratio(F.col("avoided_on"), F.col("cases"))
    )


FUNNEL = ("ineligible", "unsupported", "leak", "irrelevant", "deps", "control")


def prospect_stage(cases: DataFrame) -> DataFrame:
    """Adds ``stage``: the first check a prospect fails, else off_avoided or model_hard.

    ``cases`` carries eligible, supported, guard (ok / leak / irrelevant), deps_ok, control_ok and
    off_avoided.
    """
    c = lambda name, default: F.coalesce(name, F.lit(default))
    stage = (
        F.when(~c("eligible", False), "ineligible")
        .when(~c("supported", False), "unsupported")
        .when(c("guard", "ok") == "leak", "leak")
        .when(c("guard", "ok") == "irrelevant", "irrelevant")
        .when(~c("deps_ok", True), "deps")
        .when(~c("control_ok", False), "control")
        .when(c("off_avoided", False), "off_avoided")
        .otherwise("model_hard")
    )
    return cases.withColumn("stage", stage)


def prospect_funnel(cases: DataFrame) -> DataFrame:
    """One row: scanned, eligible, drafted, skips by reason, off_avoided, model_hard, card_helped."""
    s = F.col("stage")
    return prospect_stage(cases).agg(
        F.count("*").alias("scanned"),
        count_if(s != "ineligible").alias("eligible"),
        count_if(s.isin("off_avoided", "model_hard")).alias("drafted"),
        *[count_if(s == name).alias(f"skipped_{name}") for name in FUNNEL],
        count_if(s == "off_avoided").alias("off_avoided"),
        count_if(s == "model_hard").alias("model_hard"),
        count_if((s == "model_hard") & F.coalesce("on_avoided", F.lit(False))).alias("card_helped"),
    )


def latency_stats(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, approvals, rejections and nearest-rank p50 / p95 of ``ms``; failed calls do not count.

    Ranks come from histograms that are refined (:func:`nearest_ranks`), so a group may have any size.
    """
    ok = calls.where(F.coalesce("error", F.lit("")) == "") if "error" in calls.columns else calls
    counts = ok.groupBy(*by).agg(
        F.count("*").alias("calls"),
        count_if(F.col("approved")).alias("approvals"),
        count_if(~F.col("approved")).alias("rejections"),
    )
    ranks = nearest_ranks(ok, by, "ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    group = F.struct(F.lit(0).alias("all"), *[counts[c] for c in by])
    return counts.join(ranks, group.eqNullSafe(ranks["g"]), "left").select(
        *[counts[c] for c in by], "calls", "approvals", "rejections", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("p50_ms", "p95_ms")]
    )
