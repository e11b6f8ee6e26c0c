"""Event logs and queues: decisions, outcomes, cohorts, queue files, run manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators.records import RE_RFC3339
from ..schemas import COHORT, DECISION, OUTCOME, QUEUES, RUN_MANIFEST

TEAM = r"^[A-Za-z0-9_.-]{1,64}\z"


def _bad_time(c) -> Column:
    ok = X.col(c).rlike(RE_RFC3339) & F.try_to_timestamp(X.col(c)).isNotNull()
    return ~F.coalesce(ok, F.lit(False))


def decision_problem() -> Column:
    """First broken rule of a decision row (null when valid); expects ``keys`` of the raw object."""
    known = [f.name for f in StructType.fromDDL(DECISION).fields]
    served = F.coalesce("served", F.array().cast("array<struct<id:string,score:double>>"))
    channel, trigger = F.col("channel"), F.coalesce("trigger", F.lit(""))
    return (
        F.when(F.col("keys").isNull(), "malformed")
        .when(F.array_contains("keys", "query_text"), "query_text_forbidden")
        .when(F.size(F.array_except("keys", F.array(*[F.lit(k) for k in known]))) > 0, "unknown_key")
        .when(_bad_time("ts"), "timestamp")
        .when(~X.valid_hash("query_hash"), "query_hash")
        .when((F.coalesce("session", F.lit("")) != "") & ~X.valid_hash("session"), "session")
        .when(~F.coalesce(channel.isin("push", "search"), F.lit(False)), "channel")
        .when((channel == "push") & ~trigger.isin("prompt", "error"), "trigger")
        .when((channel == "search") & (trigger != ""), "trigger")
        .when(F.coalesce("count", F.lit(0)) != F.size(served), "count")
        .when(F.exists(served, lambda h: ~X.valid_id(h["id"]) | F.isnan(F.coalesce(h["score"], F.lit(0.0)))), "served")
    )


def parse_decisions(lines: DataFrame) -> DataFrame:
    """(file, raw, problem, <decision columns>) of raw JSON lines (file, value)."""
    return (
        lines.select("file", F.col("value").alias("raw"), F.from_json("value", DECISION).alias("d"), F.json_object_keys("value").alias("keys"))
        .select("file", "raw", "keys", "d.*")
        .withColumn("problem", decision_problem())
        .drop("keys")
    )


def read_decisions(spark: SparkSession, paths: Sequence[str], mode: str = "disjoint") -> DataFrame:
    """Valid decisions of several log files; the job fails on the first invalid line.

    disjoint keeps every row; overlap-snapshot keeps each identical row as often as it occurs in
    the file where it occurs most.
    """
    if mode not in ("disjoint", "overlap-snapshot"):
        raise ValueError(f"unknown telemetry input mode {mode!r}")
    if not paths or len(set(paths)) != len(list(paths)):
        raise ValueError("telemetry paths must be given once each")
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = parse_decisions(lines)
    checked = parsed.where(
        F.when(F.col("problem").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid telemetry line in "), "file", F.lit(": "), "problem")).cast("boolean")
        )
    )
    return overlap_snapshot(checked) if mode == "overlap-snapshot" else checked.drop("file", "raw", "problem")


def overlap_snapshot(rows: DataFrame) -> DataFrame:
    """Per identical decision, the largest multiplicity over files."""
    columns = [c for c in rows.columns if c not in ("file", "raw", "problem")]
    per_file = rows.groupBy("file", *columns).agg(F.count("*").alias("_n"))
    most = per_file.groupBy(*columns).agg(F.max("_n").alias("_n"))
    return most.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(*columns)


def outcome_problem() -> Column:
    used, flag = F.col("used"), lambda c: F.coalesce(c, F.lit(False))
    exposure = F.coalesce("exposure_id", F.lit(""))
    return (
        F.when(_bad_time("ts"), "timestamp")
        .when(~X.valid_hash("session_hash"), "session_hash")
        .when(~X.valid_id("record_id"), "record_id")
        .when((exposure != "") & ~X.valid_hash(exposure), "exposure_id")
        .when(used.isNull() & ~flag("confirmed") & ~flag("incorrect"), "no_signal")
        .when(flag("confirmed") & flag("incorrect"), "contradiction")
        .when(flag("confirmed") & ~flag("used"), "confirmed_without_use")
    )


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome rows; the job fails on malformed JSON or a broken row rule."""
    rows = spark.read.schema(OUTCOME).option("mode", "FAILFAST").json(path)
    return rows.where(
        F.when(outcome_problem().isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid outcome: "), outcome_problem())).cast("boolean")
        )
    )


def cohort_conflicts(cohorts: DataFrame) -> DataFrame:
    """Sessions listed for more than one team."""
    return cohorts.groupBy("session_hash").agg(F.countDistinct("team").alias("teams")).where(F.col("teams") > 1)


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """(team, session_hash); bad rows and sessions in two teams fail the job."""
    rows = spark.read.schema(COHORT).option("header", "true").option("enforceSchema", "false").csv(path)
    ok = F.coalesce(F.col("team").rlike(TEAM), F.lit(False)) & X.valid_hash("session_hash")
    checked = rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid cohorts row")).cast("boolean")))
    if not cohort_conflicts(checked).isEmpty():
        raise ValueError("a session appears in multiple teams")
    return checked.distinct()


def read_queue(spark: SparkSession, path: str, kind: str, streaming: bool = False) -> DataFrame:
    """Queue entries, one JSON object per file, with ``file_name`` (time-ordered) and ``readable``.

    Unreadable entries stay in the table with ``readable`` false, so that nothing is dropped.
    """
    schema = QUEUES[kind] + ", _corrupt STRING"
    reader = spark.readStream if streaming else spark.read
    rows = (
        reader.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    )
    return rows.withColumn("file_name", F.col("_metadata.file_name")).withColumn("readable", F.col("_corrupt").isNull()).drop("_corrupt")


def read_run_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests, one row per action: (run_id, stage, anomaly, id, outcome, ...)."""
    return manifest_actions(spark.read.schema(RUN_MANIFEST).option("multiLine", "true").json(path))


def manifest_actions(rows: DataFrame) -> DataFrame:
    """:func:`read_run_manifests` over a table of manifests."""
    return rows.select("run_id", "stage", "anomaly", F.inline_outer("actions"))
