"""Usage counters, quotas, tenants, digests and session attribution over event logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ranking import bucketed_row_number
from ..functions.stats import count_if, ratio

# Daily contribution limits per tool and the tenant window.
CONTRIBUTION_LIMITS = {"record_experience": 10, "report_outcome": 25, "report_issue": 25, "confirm_helpful": 50}
TENANT_WINDOW_DAYS = 7
DIGEST_TOP, DIGEST_SAMPLES, SAMPLE_CHARS = 5, 3, 80


def status_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("total"),
        count_if(F.col("status") == "validated").alias("validated"),
        count_if(F.col("status") == "quarantined").alias("quarantined"),
    )


def usage_counters(events: DataFrame, totals: bool = False) -> DataFrame:
    """(record_id, retrieved, pushed, confirmed_helpful, last_hit) from (record_id, action, day).

    Actions are retrieve / push / confirm; only a retrieve moves ``last_hit``.  With
    ``totals`` a row with a null record_id carries the grand totals.
    """
    action = F.col("action")
    known = events.where(action.isin("retrieve", "push", "confirm"))
    grouped = known.rollup("record_id") if totals else known.groupBy("record_id")
    return grouped.agg(
        count_if(action == "retrieve").alias("retrieved"),
        count_if(action == "push").alias("pushed"),
        count_if(action == "confirm").alias("confirmed_helpful"),
        F.max(F.when(action == "retrieve", F.col("day"))).alias("last_hit"),
    )


def record_usage(records: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage of every record; records without events read zero."""
    zero = F.lit(0).cast("bigint")
    return records.select("record_id").join(usage, "record_id", "left").select(
        "record_id",
        *[F.coalesce(c, zero).alias(c) for c in ("retrieved", "pushed", "confirmed_helpful")],
        "last_hit",
    )


def top_records(usage: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """The n busiest records by retrieved + pushed; unknown records are left out."""
    joined = usage.join(records.select("record_id", "title"), "record_id")
    if n <= 0:
        return joined.select("record_id", "retrieved", "pushed", "title").where(F.lit(False))
    busy = F.col("retrieved") + F.col("pushed")
    return joined.orderBy(busy.desc(), "record_id").limit(n).select("record_id", "retrieved", "pushed", "title")


def tenant_stats(tokens: DataFrame, calls: DataFrame, now: str, days: int = TENANT_WINDOW_DAYS) -> DataFrame:
    """Per token: calls today, calls in the trailing UTC days (today included), and a per-tool map.

    ``tokens`` is (token_id, label, revoked_at, daily_quota); ``calls`` is (token_id, tool, ts).
    """
    today = F.lit(now).cast("date")
    day = F.col("ts").cast("date")
    window = calls.where((day > F.date_sub(today, days)) & (day <= today)).withColumn("is_today", day == today)
    per_tool = window.groupBy("token_id", "tool").agg(F.count("*").alias("n"), count_if(F.col("is_today")).alias("today"))
    per_token = per_tool.groupBy("token_id").agg(
        F.sum("today").alias("calls_today"),
        F.sum("n").alias("calls_window"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("top_tools"),
    )
    zero = F.lit(0).cast("bigint")
    return tokens.join(per_token, "token_id", "left").select(
        "token_id",
        "label",
        F.col("revoked_at").isNotNull().alias("revoked"),
        "daily_quota",
        F.coalesce("calls_today", zero).alias("calls_today"),
        F.coalesce("calls_window", zero).alias("calls_window"),
        F.coalesce("top_tools", F.create_map().cast("map<string,bigint>")).alias("top_tools"),
    )


def tenant_profile(tokens: DataFrame, entitlements: DataFrame, usage: DataFrame, day: str) -> DataFrame:
    """Tokens with their organisation, workspace, plan and today's calls ('' and 0 where unknown)."""
    today = usage.where(F.col("day") == F.lit(day).cast("date")).select("token_id", "calls")
    out = tokens.join(entitlements, "token_id", "left").join(today, "token_id", "left")
    for c in ("organization_id", "workspace_id", "plan"):
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    return out.withColumn("calls_today", F.coalesce("calls", F.lit(0).cast("bigint"))).drop("calls")


def _call_ranks(calls: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Rank calls of a (keys, UTC day) group by time; a hot group is ranked minute by minute."""
    daily = calls.withColumn("day", F.col("ts").cast("date"))
    return bucketed_row_number(daily, [*keys, "day"], ["ts", *order_cols], F.date_trunc("minute", "ts"), "n")


def quota_admission(calls: DataFrame, quotas: DataFrame, order_cols: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Adds (day, n, admitted) to calls (token_id, ts, ...): the first ``daily_quota`` calls of a day.

    A quota of zero or less is unlimited; rejected calls do not consume quota, so admission is
    exactly 'rank within the day is at most the quota'.  A token without a quota row is rejected.
    """
    ranked = _call_ranks(calls, ["token_id"], list(order_cols)).join(quotas, "token_id", "left")
    quota = F.col("daily_quota")
    return ranked.withColumn("admitted", F.coalesce((quota <= 0) | (F.col("n") <= quota), F.lit(False))).drop("daily_quota")


def contribution_admission(
    calls: DataFrame, limits: Mapping[str, int] = CONTRIBUTION_LIMITS, order_cols: tuple[str, ...] = ("call_id",)
) -> DataFrame:
    """Adds (day, n, admitted) to calls (token_id, tool, ts, alpha, ...).

    Only alpha tenants are limited, per tool and UTC day; a tool without a positive limit is
    refused to them.
    """
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    limit = F.coalesce(table[F.col("tool")], F.lit(0))
    ranked = _call_ranks(calls, ["token_id", "tool"], list(order_cols))
    return ranked.withColumn("admitted", ~F.col("alpha") | ((limit > 0) & (F.col("n") <= limit)))


def served_in_session(decisions: DataFrame, session: str | None = None) -> DataFrame:
    """(session, record_id): distinct ids served to a salted session; an empty session matches nothing."""
    rows = decisions.where(F.coalesce("session", F.lit("")) != "")
    if session is not None:
        rows = rows.where(F.col("session") == session) if session else rows.where(F.lit(False))
    return rows.select("session", F.explode("served").alias("s")).select("session", F.col("s.id").alias("record_id")).distinct()


def attribute_helpfulness(verdicts: DataFrame, served: DataFrame) -> DataFrame:
    """(session, record_id): used, well-formed, actually served, once per session."""
    return (
        verdicts.where(F.col("used") & X.valid_id("record_id"))
        .select("session", "record_id")
        .distinct()
        .join(served.select("session", "record_id"), ["session", "record_id"], "left_semi")
    )


def metrics_digest(
    decisions: DataFrame, now: str, hours: float = 24.0, top_ids: int = DIGEST_TOP, samples_shown: int = DIGEST_SAMPLES, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(section, key, queries, served, rate) of the decisions in the last hours.

    Sections: push, trigger (per trigger), search, top (most served ids: count in ``served``),
    sample (first served query texts, in log order).
    """
    ts = F.to_timestamp("ts")
    # Strictness is the source's job; a digest skips unreadable timestamps.
    recent = decisions.withColumn("_t", ts).where(
        F.col("_t") >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(0), secs=F.lit(float(hours) * 3600))
    )
    hit = F.coalesce("count", F.lit(0)) > 0
    sums = [F.count("*").alias("queries"), count_if(hit).alias("served")]
    channels = recent.where(F.col("channel").isin("push", "search")).groupBy("channel").agg(*sums)
    seeds = decisions.sparkSession.createDataFrame([("push",), ("search",)], "channel string")
    zero = F.lit(0).cast("bigint")
    by_channel = seeds.join(channels, "channel", "left").select(
        F.col("channel").alias("section"), F.lit("").alias("key"),
        F.coalesce("queries", zero).alias("queries"), F.coalesce("served", zero).alias("served"),
    )
    push = recent.where(F.col("channel") == "push")
    by_trigger = push.where(F.col("trigger").isNotNull()).groupBy("trigger").agg(*sums).select(
        F.lit("trigger").alias("section"), F.col("trigger").alias("key"), "queries", "served"
    )
    served = push.where(hit)
    top = (
        served.select(F.explode("served").alias("s")).where(F.coalesce("s.id", F.lit("")) != "")
        .groupBy(F.col("s.id").alias("key")).agg(F.count("*").alias("served"))
        .orderBy(F.col("served").desc(), "key").limit(top_ids)
        .select(F.lit("top").alias("section"), "key", F.lit(None).cast("bigint").alias("queries"), "served")
    )
    out = by_channel.unionByName(by_trigger).unionByName(top)
    if "query_text" in decisions.columns:
        samples = (
            served.where(F.coalesce("query_text", F.lit("")) != "")
            .orderBy("_t", "query_text").limit(samples_shown)
            .select(
                F.lit("sample").alias("section"), F.substring("query_text", 1, chars).alias("key"),
                F.lit(None).cast("bigint").alias("queries"), F.lit(None).cast("bigint").alias("served"),
            )
        )
        out = out.unionByName(samples)
    share = F.when(F.col("queries").isNotNull(), F.round(ratio(F.col("served"), F.col("queries")) * 100, 1))
    return out.withColumn("rate", share)


def daily_calls(calls: DataFrame) -> DataFrame:
    """(token_id, day, tool, calls): the per-tool daily counters."""
    return calls.groupBy("token_id", F.col("ts").cast("date").alias("day"), "tool").agg(F.count("*").alias("calls"))
