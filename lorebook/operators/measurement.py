"""Pilot measurement: arms, exposures, outcome attribution and rates with 95% intervals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import bucketed_row_number
from ..functions.stats import count_if, wilson
from ..session import cut_lineage

# Fixed value: leading part of an exposure identity.
EXPOSURE_NAMESPACE = "exposure-v1"


@dataclass(frozen=True)
class Window:
    """Half-open [start, end), ISO timestamps."""

    start: str
    end: str


def check_windows(baseline: Window, treatment: Window) -> None:
    """Each window must be non-empty and the two must not overlap."""
    spans = [(datetime.fromisoformat(w.start), datetime.fromisoformat(w.end)) for w in (baseline, treatment)]
    if any(start >= end for start, end in spans):
        raise ValueError("each window requires start < end")
    (bs, be), (ts, te) = spans
    if bs < te and ts < be:
        raise ValueError("baseline and treatment windows overlap")


def arm_filter(df: DataFrame, baseline: Window, treatment: Window, ts_col: str = "ts") -> DataFrame:
    """Adds ``arm`` and drops rows outside both windows or with an unreadable time."""
    check_windows(baseline, treatment)
    t = F.try_to_timestamp(F.col(ts_col).cast("string"))
    inside = lambda w: (t >= F.lit(w.start).cast("timestamp")) & (t < F.lit(w.end).cast("timestamp"))
    arm = F.when(inside(baseline), "baseline").when(inside(treatment), "treatment")
    return df.withColumn("arm", arm).where(F.col("arm").isNotNull())


def cohort_join(df: DataFrame, cohorts: DataFrame, session_col: str = "session") -> DataFrame:
    """Adds ``team``: the session's cohort, or 'unattributed'."""
    teams = cohorts.select(F.col("session_hash").alias("_s"), F.nullif("team", F.lit("")).alias("team"))
    joined = df.join(teams, F.col(session_col) == F.col("_s"), "left").drop("_s")
    return joined.withColumn("team", F.coalesce("team", F.lit("unattributed")))


def exposure_ids(decisions: DataFrame, namespace: str = EXPOSURE_NAMESPACE) -> DataFrame:
    """One row per served record with its stable ``exposure_id``.

    ``decisions`` carries ts, channel, trigger, session, query_hash and ``served``; rows with
    malformed ids are dropped.  Identical exposures are told apart by an ordinal.
    """
    parts = ["ts", "channel", "trigger", "session", "query_hash"]
    carry = [c for c in decisions.columns if c not in ("served", *parts)]
    rows = (
        decisions.select(*[F.coalesce(c, F.lit("")).alias(c) for c in parts], *carry, F.explode("served").alias("s"))
        .select(*parts, *carry, F.col("s.id").alias("record_id"))
        .where(X.valid_id("record_id"))
    )
    # Identical exposures are interchangeable: number them through their count.
    base = [*parts, "record_id", *carry]
    counted = rows.groupBy(*base).agg(F.count("*").alias("_n"))
    out = counted.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
    key = [F.lit(namespace), *[F.col(c) for c in parts], F.col("record_id"), F.col("ordinal").cast("string")]
    text = F.concat(*[x for part in key for x in (part, F.lit("\0"))])
    return out.withColumn("exposure_id", F.substring(F.sha2(text, 256), 1, 32))


def attribute_outcomes(exposures: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, errors).

    An outcome naming an exposure must agree with its session and record, once.  Outcomes
    without one take the exposures of their session and record that no outcome names, first
    in first out by (time, id): the n-th outcome meets the n-th free exposure.
    """
    o = outcomes.select(
        F.col("ts").alias("outcome_ts"), F.coalesce("exposure_id", F.lit("")).alias("named"),
        F.col("session_hash").alias("session"), "record_id", "used", "confirmed", "incorrect",
    )
    e = exposures.select("exposure_id", "session", "record_id", F.col("ts").alias("exposure_ts"), "arm", "team")
    signals = ["used", "confirmed", "incorrect"]
    explicit = o.where(F.col("named") != "")
    joined = explicit.join(e.withColumnRenamed("session", "_s").withColumnRenamed("record_id", "_r"), F.col("named") == F.col("exposure_id"), "left")
    agrees = (F.col("_s") == F.col("session")) & (F.col("_r") == F.col("record_id"))
    checked = joined.withColumn("ok", F.coalesce(agrees, F.lit(False)))
    claims = checked.where("ok").groupBy("exposure_id").agg(F.count("*").alias("claims"))
    named = checked.where("ok").join(claims, "exposure_id")
    cols = ["exposure_id", "session", "record_id", "arm", "team", *signals]
    by_name = named.where(F.col("claims") == 1).select(*cols)
    free = e.join(explicit.select(F.col("named").alias("exposure_id")), "exposure_id", "left_anti")
    keys = ["session", "record_id"]
    # RFC3339 text sorts lexically here; its leading characters bucket a hot session.
    slots = bucketed_row_number(free, keys, ["exposure_ts", "exposure_id"], F.substring("exposure_ts", 1, 16), "slot")
    legacy = o.where(F.col("named") == "")
    order = ["outcome_ts", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in signals]]
    ranked = bucketed_row_number(legacy, keys, order, F.substring("outcome_ts", 1, 16), "slot")
    zipped = ranked.join(slots, [*keys, "slot"], "left")
    fifo = zipped.where(F.col("exposure_id").isNotNull()).select(*cols)
    problem = lambda df, text: df.select(
        "session", "record_id", "outcome_ts", F.lit(text).alias("problem")
    )
    errors = (
        problem(checked.where(~F.col("ok")), "unknown_or_mismatched_exposure")
        .unionByName(problem(named.where(F.col("claims") > 1), "duplicate_outcome"))
        .unionByName(problem(zipped.where(F.col("exposure_id").isNull()), "no_unclaimed_exposure"))
    )
    return by_name.unionByName(fifo), errors


def pilot_metrics(
    decisions: DataFrame,
    outcomes: DataFrame,
    cohorts: DataFrame,
    baseline: Window,
    treatment: Window,
    namespace: str = EXPOSURE_NAMESPACE,
) -> DataFrame:
    """The pilot report: one row per (scope, arm, team, record_id) with counts and six rates.

    Scopes are aggregate (both arms always present), team and record.  A decision's exposures
    count every served hit; record rows only well-formed ids.  Repeated errors are the n - 1
    later error-triggered pushes of the same session and query within a group.
    """
    d = cohort_join(arm_filter(decisions, baseline, treatment), cohorts)
    served = F.coalesce(F.size("served"), F.lit(0))
    served = F.when(served > 0, served).otherwise(0)
    is_error = (F.col("channel") == "push") & (F.col("trigger") == "error")
    session, query = F.coalesce("session", F.lit("")), F.coalesce("query_hash", F.lit(""))
    tracked = is_error & (session != "") & (query != "")
    # First combine per (arm, team, session, query): a session belongs to one team, so the
    # arm level only needs the team level summed.
    # A repeated error is counted inside each level's own group.
    per_query = d.groupBy("arm", "team", session.alias("session"), query.alias("query_hash")).agg(
        F.count("*").alias("decisions"),
        count_if(served > 0).alias("exposed_decisions"),
        F.sum(served.cast("bigint")).alias("exposures"),
        count_if(is_error).alias("error_decisions"),
        F.greatest(count_if(tracked) - 1, F.lit(0)).alias("repeated_errors"),
    )
    counts = ["decisions", "exposed_decisions", "exposures", "error_decisions", "repeated_errors"]
    levels = (
        per_query.groupingSets([["arm"], ["arm", "team"]], "arm", "team")
        .agg(*[F.sum(c).alias(c) for c in counts], F.grouping("team").alias("g"))
        .select(F.when(F.col("g") == 1, "aggregate").otherwise("team").alias("scope"), "arm", F.coalesce("team", F.lit("")).alias("team"), *counts)
    )
    # Ranked, matched and counted below: materialised once.
    exposures = cut_lineage(
        exposure_ids(d.select("ts", "channel", "trigger", "session", "query_hash", "served", "arm", "team"), namespace)
    )
    matched, _ = attribute_outcomes(exposures, outcomes)
    signals = [
        count_if(F.col("used").isNotNull() | F.coalesce("incorrect", F.lit(False))).alias("judged"),
        count_if(F.coalesce("used", F.lit(False))).alias("used"),
        count_if(F.coalesce("confirmed", F.lit(False))).alias("confirmed"),
        count_if(F.coalesce("incorrect", F.lit(False))).alias("incorrect"),
    ]
    per_record = matched.groupBy("arm", "team", "record_id").agg(*signals)
    sums = ["judged", "used", "confirmed", "incorrect"]
    rolled = (
        per_record.groupingSets([["arm"], ["arm", "team"], ["arm", "team", "record_id"]], "arm", "team", "record_id")
        .agg(*[F.sum(c).alias(c) for c in sums], F.grouping("team").alias("gt"), F.grouping("record_id").alias("gr"))
        .select(
            F.when(F.col("gt") == 1, "aggregate").when(F.col("gr") == 1, "team").otherwise("record").alias("scope"),
            "arm", F.coalesce("team", F.lit("")).alias("team"), F.coalesce("record_id", F.lit("")).alias("record_id"), *sums,
        )
    )
    shown = exposures.groupBy("arm", "team", "record_id").agg(F.count("*").alias("exposures"))
    seeds = decisions.sparkSession.createDataFrame(
        [("aggregate", "baseline", "", ""), ("aggregate", "treatment", "", "")],
        "scope string, arm string, team string, record_id string",
    )
    keys = ["scope", "arm", "team", "record_id"]
    null = F.lit(None).cast("bigint")
    frames = (
        seeds.join(levels.withColumn("record_id", F.lit("")), keys, "left")
        .unionByName(levels.where(F.col("scope") == "team").withColumn("record_id", F.lit("")).select(*keys, *counts))
        .unionByName(
            shown.select(
                F.lit("record").alias("scope"), "arm", "team", "record_id",
                null.alias("decisions"), null.alias("exposed_decisions"), "exposures",
                null.alias("error_decisions"), null.alias("repeated_errors"),
            )
        )
    )
    zero = F.lit(0).cast("bigint")
    is_record = F.col("scope") == "record"
    full = frames.join(rolled, keys, "left").select(
        *keys,
        *[
            F.when(is_record & F.lit(c != "exposures"), null).otherwise(F.coalesce(c, zero)).alias(c)
            for c in ("decisions", "exposed_decisions", "exposures")
        ],
        *[F.coalesce(c, zero).alias(c) for c in sums],
        *[F.when(is_record, null).otherwise(F.coalesce(c, zero)).alias(c) for c in ("error_decisions", "repeated_errors")],
    )
    rates = {
        "hit": ("exposed_decisions", "decisions"),
        "outcome_coverage": ("judged", "exposures"),
        "used": ("used", "judged"),
        "helpful": ("confirmed", "exposures"),
        "incorrect": ("incorrect", "judged"),
        "repeated_error": ("repeated_errors", "error_decisions"),
    }
    for name, (num, den) in rates.items():
        value = name if name == "outcome_coverage" else f"{name}_rate"
        r = wilson(F.col(num), F.col(den))
        blank = is_record & F.lit(name in ("hit", "repeated_error"))
        for field, column in (("value", value), ("low", f"{name}_low_95"), ("high", f"{name}_high_95")):
            full = full.withColumn(column, F.when(~blank, r[field]))
    return full
