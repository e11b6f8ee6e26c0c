"""Draft intake: novelty, screening, quarantine, dedup, id allocation, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..functions.ranking import distributed_row_number
from ..schemas import RECORD
from .advisories import defects_column
from .records import _strings, violations_column
from .retrieval import CorpusIndex, assess_novelty
from .screening import findings_column, flags_column

# Texts of a counter-record.
REPORT_TITLE = "Outcome report against %s — reported %s"
REPORT_SUMMARY = "A consuming agent reported that the lesson in %s did not work (outcome: %s)."
REPORT_TRIED = "Relied on the lesson in %s"
REPORT_NO_EVIDENCE = "reported outcome: %s; no reproducible artifact provided (triage flag)"
REPORT_BODY = (
    "## Outcome report\n\n"
    "A consuming agent reported that the lesson in **%1$s** did not hold.\n\n"
    "- **disputes:** %1$s\n- **outcome:** %2$s\n\n"
    "### Evidence\n\n%3$s"
)
TITLE_MAX = 120


def typed(df: DataFrame, schema: str = RECORD) -> DataFrame:
    """Project to the record schema; missing columns become null."""
    fields = StructType.fromDDL(schema).fields
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def batch_key() -> Column:
    """Primary dedup signal of a draft: first non-blank signature, else the title."""
    first = F.get(F.filter(_strings("symptom.error_signatures"), lambda s: ~X.is_blank(s)), F.lit(0))
    return F.coalesce(X.utrim(first), F.col("title"))


def dedup_drafts(drafts: DataFrame, order_col: str = "seq", creatable_col: str = "creatable") -> DataFrame:
    """Adds ``accepted``: the first creatable draft of each key; drafts that cannot be created claim nothing.

    A key shared by a third of the drafts stays cheap: its first draft is an aggregate
    (combined map-side), not a sorted group.
    """
    keyed = drafts.withColumn("key", batch_key())
    first = keyed.where(F.col(creatable_col)).groupBy("key").agg(F.min(order_col).alias("_first"))
    return keyed.join(first, "key", "left").withColumn(
        "accepted", F.coalesce(F.col(creatable_col) & (F.col(order_col) == F.col("_first")), F.lit(False))
    ).drop("_first")


def draft_probes(drafts: DataFrame) -> DataFrame:
    """(query_id, draft_id, pos, text): signatures, then the summary, or the title when there is neither."""
    sigs = F.filter(_strings("symptom.error_signatures"), lambda s: ~X.is_blank(s))
    summary = X.utrim(F.coalesce("symptom.summary", F.lit("")))
    signals = F.concat(sigs, F.when(summary != "", F.array(summary)).otherwise(F.array().cast("array<string>")))
    title = X.utrim(F.coalesce("title", F.lit("")))
    fallback = F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    probes = drafts.select(
        "draft_id", F.posexplode(F.when(F.size(signals) > 0, signals).otherwise(fallback)).alias("pos", "text")
    )
    return probes.withColumn("query_id", F.concat_ws("#", F.col("draft_id").cast("string"), F.col("pos").cast("string")))


def scan_texts() -> Column:
    """Every free-text field of a record, for the safety gate."""
    dead_ends = F.coalesce(
        F.col("resolution.dead_ends"), F.array().cast("array<struct<tried:string,why_it_failed:string>>")
    )
    repros = F.coalesce(F.col("guard.repros"), F.array().cast("array<struct<path:string,kind:string,label:string>>"))
    applies = F.coalesce(
        F.transform(
            "applies_to",
            lambda a: F.concat(
                F.array(a["ecosystem"], a["package"], a["versions"]["introduced"], a["versions"]["fixed"]),
                F.coalesce(F.map_keys(a["runtime"]), F.array().cast("array<string>")),
                F.coalesce(F.map_values(a["runtime"]), F.array().cast("array<string>")),
            ),
        ),
        F.array().cast("array<array<string>>"),
    )
    return F.array_compact(
        F.concat(
            F.array("title", "body", "symptom.summary"),
            _strings("symptom.error_signatures"),
            F.array("resolution.root_cause", "resolution.fix"),
            F.flatten(F.transform(dead_ends, lambda d: F.array(d["tried"], d["why_it_failed"]))),
            F.array("guard.repro", "guard.guarding_test"),
            F.flatten(F.transform(repros, lambda r: F.array(r["path"], r["label"]))),
            F.flatten(applies),
        )
    )


def record_path(now: Column, record_id: Column, title: Column) -> Column:
    """experience/<year>/<number>-<slug>.md"""
    return F.concat(
        F.lit("experience/"), F.substring(now, 1, 4), F.lit("/"), F.regexp_replace(record_id, "^exp-", ""),
        F.lit("-"), X.slug(title), F.lit(".md"),
    )


def _quarantined(drafts: DataFrame, now: str, author: Column, session: Column) -> DataFrame:
    """Drafts with an id -> typed quarantined records."""
    source = F.struct(author.alias("author"), session.cast("string").alias("session"), F.lit(None).cast("string").alias("pr"))
    have = set(drafts.columns)
    opt = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    provenance = F.struct(
        source.alias("source"),
        F.lit(now).alias("recorded_at"),
        F.struct(F.lit(now).alias("from"), F.lit(None).cast("string").alias("until")).alias("valid"),
        opt("source_license").alias("source_license"),
        opt("source_url").alias("source_url"),
        opt("disputes").alias("disputes"),
    )
    prov_type = StructType.fromDDL(RECORD)["provenance"].dataType
    full = F.struct(
        *[
            (provenance[f.name] if f.name in ("source", "recorded_at", "valid", "source_license", "source_url", "disputes") else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in prov_type.fields
        ]
    )
    built = (
        drafts.withColumn("schema_version", F.lit(1))
        .withColumn("status", F.lit("quarantined"))
        .withColumn("body", X.utrim(F.coalesce("body", F.lit(""))))
        .withColumn("provenance", full)
        .withColumn("path", record_path(F.lit(now), F.col("id"), F.col("title")))
    )
    return typed(built)


def _gated(records: DataFrame) -> DataFrame:
    """Stamp security and consistency flags (null when there are none)."""
    flags = F.nullif(flags_column(F.col("_f")), F.array().cast("array<string>"))
    defects = F.nullif(defects_column(), F.array().cast("array<string>"))
    # The texts are read once per rule: compute them before the rules.
    out = records.withColumn("_t", scan_texts()).withColumn("_f", findings_column(F.col("_t")))
    out = out.withColumn("_s", flags).withColumn("_d", defects).drop("_t", "_f")
    return out.withColumn(
        "provenance", F.col("provenance").withField("security_flags", F.col("_s")).withField("consistency_flags", F.col("_d"))
    ).drop("_s", "_d")


def prepare_drafts(
    drafts: DataFrame,
    index: CorpusIndex,
    now: str,
    author: str = "importer",
    repo: str | None = None,
    include_quarantined: bool = True,
    reject_on_flag: bool = False,
    floor: float | None = None,
) -> DataFrame:
    """(draft_id, novelty, outcome, rules, record) for drafts carrying (draft_id, id, kind, title, ...).

    outcome is known (a probe hits an existing fingerprint), rejected (flagged under
    ``reject_on_flag``), invalid (row rules fail; see ``rules``) or created.
    """
    probes = draft_probes(drafts)
    verdicts = assess_novelty(probes.select("query_id", "text"), index, floor, repo, include_quarantined=include_quarantined)
    rank = F.when(F.col("novelty") == "known", 2).when(F.col("novelty") == "similar", 1).otherwise(0)
    per_draft = (
        probes.select("query_id", "draft_id").join(verdicts.select("query_id", "novelty"), "query_id")
        .groupBy("draft_id")
        .agg(F.max(rank).alias("level"))
    )
    have = set(drafts.columns)
    own_author = F.nullif(X.utrim("author"), F.lit("")) if "author" in have else F.lit(None)
    session = F.col("session") if "session" in have else F.lit(None)
    records = _gated(_quarantined(drafts, now, F.coalesce(own_author, F.lit(author)), session))
    prepared = drafts.select("draft_id", "id").join(
        records.select("id", F.struct(*[F.col(c) for c in records.columns]).alias("record"), violations_column(now).alias("rules")), "id"
    )
    level = F.coalesce("level", F.lit(0))
    flagged = F.col("record.provenance.security_flags").isNotNull() | F.col("record.provenance.consistency_flags").isNotNull()
    return prepared.join(per_draft, "draft_id", "left").select(
        "draft_id",
        F.when(level == 2, "known").when(level == 1, "similar").otherwise("novel").alias("novelty"),
        F.when(level == 2, "known")
        .when(flagged & F.lit(reject_on_flag), "rejected")
        .when(F.size("rules") > 0, "invalid")
        .otherwise("created")
        .alias("outcome"),
        "rules",
        "record",
    )


def candidates_to_drafts(candidates: DataFrame) -> DataFrame:
    """Flat queue or transcript candidates -> draft rows (empty blocks become null)."""
    have = set(candidates.columns)
    get = lambda n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("")
    sigs = _strings("error_signatures") if "error_signatures" in have else F.array().cast("array<string>")
    null = F.lit(None).cast
    return candidates.select(
        *[c for c in ("draft_id", "id", "author", "session", "source_license", "source_url") if c in have],
        get("kind").alias("kind"),
        get("title").alias("title"),
        F.when(
            (get("summary") != "") | (F.size(sigs) > 0),
            F.struct(
                get("summary").alias("summary"), sigs.alias("error_signatures"),
                null("struct<app:array<string>,generic:array<string>>").alias("fingerprints"),
            ),
        ).alias("symptom"),
        F.when(
            (get("ecosystem") != "") | (get("package") != ""),
            F.array(
                F.struct(
                    get("ecosystem").alias("ecosystem"), get("package").alias("package"),
                    null("struct<introduced:string,fixed:string>").alias("versions"),
                    null("map<string,string>").alias("runtime"),
                )
            ),
        ).alias("applies_to"),
        F.when(
            (get("root_cause") != "") | (get("fix") != ""),
            F.struct(
                get("root_cause").alias("root_cause"), get("fix").alias("fix"),
                null("array<struct<tried:string,why_it_failed:string>>").alias("dead_ends"),
            ),
        ).alias("resolution"),
        F.when(
            get("guarding_test") != "",
            F.struct(
                null("string").alias("repro"),
                null("array<struct<path:string,kind:string,label:string>>").alias("repros"),
                get("guarding_test").alias("guarding_test"),
            ),
        ).alias("guard"),
        get("body").alias("body"),
    )


def reports_to_counter_records(reports: DataFrame, now: str) -> DataFrame:
    """Outcome reports (id, record_id, outcome, evidence, author, session) -> quarantined counter-records.

    Reports about malformed ids are dropped; evidence passes the safety gate like any text.
    """
    outcome = F.coalesce(F.nullif(X.utrim("outcome"), F.lit("")), F.lit("unspecified"))
    evidence = X.utrim(F.coalesce("evidence", F.lit("")))
    rid = F.col("record_id")
    shown = F.when(evidence != "", F.concat(F.lit("```\n"), evidence, F.lit("\n```\n"))).otherwise(
        F.lit("_No reproducible artifact provided — this is a triage flag, not execution-backed counter-evidence._\n")
    )
    why = F.when(evidence != "", evidence).otherwise(F.format_string(REPORT_NO_EVIDENCE, outcome))
    drafts = reports.where(X.valid_id("record_id")).select(
        "id",
        F.lit("dead-end").alias("kind"),
        F.substring(F.format_string(REPORT_TITLE, rid, outcome), 1, TITLE_MAX).alias("title"),
        F.struct(
            F.format_string(REPORT_SUMMARY, rid, outcome).alias("summary"),
            F.lit(None).cast("array<string>").alias("error_signatures"),
            F.lit(None).cast("struct<app:array<string>,generic:array<string>>").alias("fingerprints"),
        ).alias("symptom"),
        F.struct(
            F.lit(None).cast("string").alias("root_cause"),
            F.lit(None).cast("string").alias("fix"),
            F.array(F.struct(F.format_string(REPORT_TRIED, rid).alias("tried"), why.alias("why_it_failed"))).alias("dead_ends"),
        ).alias("resolution"),
        F.format_string(REPORT_BODY, rid, outcome, shown).alias("body"),
        F.col("record_id").alias("disputes"),
        "author",
        "session",
    )
    return _gated(_quarantined(drafts, now, F.col("author"), F.col("session")))


def assign_ids(drafts: DataFrame, id_sources: Sequence[DataFrame], order_col: str = "seq", floors: Sequence[int] = ()) -> DataFrame:
    """Adds ``id``: sequential ids after the highest known one, in input order.

    ``id_sources`` are tables with an ``id`` column.  Numbering is a distributed prefix count,
    never one global sort in a single task.
    """
    numbers = id_sources[0].select(X.record_number("id").alias("n"))
    for more in id_sources[1:]:
        numbers = numbers.unionByName(more.select(X.record_number("id").alias("n")))
    start = numbers.agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(max([0, *floors]))).alias("n")).scalar()
    ranked = distributed_row_number(drafts, order_col, "_n")
    return ranked.withColumn("_start", start).withColumn("id", X.record_id(F.col("_start") + F.col("_n"))).drop("_n", "_start")


# Rows of a table that one task of the integrity check sorts or counts.
TASK_ROWS = 1 << 18


def integrity_check(records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem, detail): duplicate ids, dangling superseded_by, missing repro files.

    Ids and paths are dealt over parts of a bounded number of rows, before anything is counted, so that no
    task's tables grow with the input.
    """
    rows = max(records.count(), files.count())
    parts = max(records.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    dealt = lambda df, key: df.repartition(parts, key)
    dup = (
        dealt(records.select("id", "path"), "id").groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("first"))
        .where(F.col("n") > 1)
        .select("id", F.lit("duplicate_id").alias("problem"), F.col("n").cast("string").alias("detail"))
    )
    links = records.select("id", F.col("provenance.superseded_by").alias("target")).where(F.col("target").isNotNull())
    known = dealt(records.select(F.col("id").alias("target")), "target").distinct()
    dangling = dealt(links, "target").join(known, "target", "left_anti").select(
        "id", F.lit("dangling_superseded_by").alias("problem"), F.col("target").alias("detail")
    )
    declared = records.select(
        "id",
        F.explode(
            F.array_compact(
                F.concat(
                    F.array("guard.repro"),
                    F.coalesce(F.transform("guard.repros", lambda r: r["path"]), F.array().cast("array<string>")),
                )
            )
        ).alias("path"),
    )
    missing = dealt(declared, "path").join(dealt(files.select("path"), "path").distinct(), "path", "left_anti").select(
        "id", F.lit("missing_repro").alias("problem"), F.col("path").alias("detail")
    )
    return dup.unionByName(dangling).unionByName(missing)


def head_base_id_collision(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, path, problem, other): introduced (id, path) rows that reuse an id.

    Every base path of an id counts, so bases are collapsed to their lowest and highest path:
    an introduced path collides unless it is the only one.
    """
    taken = base.groupBy("id").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    on_base = head.join(taken, "id").where((F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path"))).select(
        "id", "path", F.lit("exists_on_base").alias("problem"),
        F.when(F.col("lo") != F.col("path"), F.col("lo")).otherwise(F.col("hi")).alias("other"),
    )
    first = head.groupBy("id").agg(F.min("path").alias("first"))
    twice = head.join(first, "id").where(F.col("path") != F.col("first")).select(
        "id", "path", F.lit("introduced_twice").alias("problem"), F.col("first").alias("other")
    )
    return on_base.unionByName(twice)
