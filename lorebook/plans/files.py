"""Registered queries of the file readers and record sinks, over files made of the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import OSV, RUN_MANIFEST
from ..session import ensure_checkpoint_dir
from ..sources import corpus as C
from ..sources import feeds
from ..sources import logs as L
from ..streaming import jobs as J
from . import sqltext as Q
from .tables import records, table

NOW = "2024-06-01"


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s)}/files/{uuid.uuid4().hex}"


def corpus_files(s, d):
    """Every document as the body of a markdown record; one in eight each without fence, with an
    unknown key, of a later version, with broken YAML, unterminated, and of an unknown kind."""
    c, rid = F.col("doc_id") % 8, X.record_id("doc_id")
    kind = F.when(c == 5, "rumour").otherwise("trap")
    front = F.concat(
        F.lit("schema_version: "), F.when(c == 2, "2").otherwise("1"), F.lit("\nid: "), rid, F.lit("\nkind: "), kind,
        F.lit('\nstatus: quarantined\ntitle: "A trap that is long enough"\n'), F.when(c == 1, "surprise: 1\n").otherwise(""),
        F.when(c == 3, "a: [\n").otherwise(""),
        F.lit("symptom: {summary: it breaks, error_signatures: [boom]}\napplies_to:\n  - ecosystem: "), F.col("lang"),
        F.lit("\n    package: "), F.when(c == 6, "on").otherwise(F.col("source")),
        F.lit("\n    versions: {introduced: "), F.when(c == 6, "1.10").otherwise('"2.0"'), F.lit(", fixed: null}\n"),
        F.lit("resolution: {root_cause: because, fix: do not}\nprovenance:\n  source: {author: me}\n  recorded_at: 2024-05-06\n  valid: {from: 2024-05-06}\n"),
    )
    value = F.concat(F.when(c == 0, "").otherwise("---\n"), front, F.when(c == 4, "").otherwise("---\n"), F.when(c == 4, "").otherwise(F.col("text")))
    path = F.concat(F.lit("/corpus/experience/2024/"), F.regexp_replace(rid, "^exp-", ""), F.lit("-"), F.col("source"), F.lit(".md"))
    good, bad = C.parse_corpus(table(s, d, "documents").select(path.alias("path"), value.alias("value")), "strict", NOW)
    a = F.col("applies_to")[0]
    ok = good.select(
        "path", F.concat_ws("|", "id", a["package"], a["versions"]["introduced"], F.length("body").cast("string")).alias("outcome"), F.lit(False).alias("critical")
    )
    return ok.unionByName(bad.select("path", F.col("reason").alias("outcome"), "critical"))


def osv_advisories(s, d):
    """Advisories of every part as JSON; some withdrawn, without id, or of another ecosystem only."""
    k = F.col("p_partkey")
    block = lambda eco, name: F.struct(F.struct(eco.alias("ecosystem"), name.alias("name")).alias("package"))
    eco = F.when(k % 5 == 0, "PyPI").otherwise("npm:v2")
    row = F.struct(
        F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("GHSA-"), k.cast("string"))).alias("id"),
        F.when(k % 7 == 0, "2024-01-01T00:00:00Z").alias("withdrawn"), F.col("p_name").alias("summary"),
        F.array(block(F.lit("Go"), F.col("p_brand")), block(eco, F.col("p_name"))).alias("affected"),
    )
    rows = table(s, d, "part").select(F.from_json(F.to_json(row), OSV).alias("r")).select("r.*")
    live = feeds.live_advisories(rows, "npm")
    return live.select("id", F.size("affected").cast("bigint").alias("blocks"), F.col("affected")[0]["package"]["name"].alias("package"))


def run_manifests(s, d):
    """A manifest per customer, one action per order, written as JSON objects and parsed again."""
    action = F.struct(X.record_id("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("outcome"))
    runs = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(action).alias("actions"))
    text = F.to_json(F.struct(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id"), F.lit("promote").alias("stage"), (F.col("o_custkey") % 2 == 0).alias("anomaly"), "actions"))
    rows = runs.select(F.from_json(text, RUN_MANIFEST).alias("r")).select("r.*")
    return L.manifest_actions(rows).select("run_id", "stage", "anomaly", "id", "outcome")


def _write_queue(s, d) -> str:
    """One JSON file per benchmark item; every ninth is blank."""
    path = _folder(s)
    text = F.when(F.col("item_id") % 9 == 0, "  ").otherwise(F.col("text"))
    entries = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("session_id"), F.lit("me").alias("author"), text.alias("transcript"))
    entries.coalesce(4).write.option("maxRecordsPerFile", 1).json(path)
    return path


def queue_entries(s, d):
    q = L.read_queue(s, _write_queue(s, d), "transcript")
    return q.select("session_id", "author", F.length("transcript").cast("bigint").alias("chars"), "readable")


def stream_queue_drain(s, d):
    """Entries of a length divisible by three are unprocessable; candidates are named by their first word."""
    source, base = _write_queue(s, d), _folder(s)

    def analyze(df):
        bad = F.when(F.length("transcript") % 3 == 0, "unprocessable").otherwise("")
        return df.select("file_name", bad.alias("error"), F.element_at(X.words("transcript"), 1).alias("title"))

    query = J.stream_queue_drain(s, source, f"{base}/checkpoint", f"{base}/sink", analyze, lambda df: df, batch_key=["title"])
    query.awaitTermination()
    read = lambda name: s.read.parquet(f"{base}/sink/{name}")
    out = read("processed").select(F.lit("processed").alias("part"), F.col("title").alias("key"), F.lit(1).cast("bigint").alias("n"))
    for part in ("dead", "queued"):
        out = out.unionByName(read(part).groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n"))
    return out.unionByName(read("alerts").select(F.lit("alert").alias("part"), F.col("alert").cast("string").alias("key"), F.col("failed").alias("n")))


def changed_records(s, d):
    """Titles of one record in four are edited, and one in ten was not stored before."""
    r = records(s, d)
    n = X.record_number("id")
    new = r.withColumn("title", F.when(n % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return C.changed_records(new, r.where(n % 10 != 0)).select("id", "title")


def flush_usage(s, d):
    """Counters of events; one record in three already carries them."""
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    count = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    usage = e.groupBy(X.record_id("k").alias("record_id")).agg(
        count("view").alias("retrieved"), count("click").alias("pushed"), count("purchase").alias("confirmed_helpful"), F.max(F.col("ts").cast("date")).alias("last_hit")
    )
    r = records(s, d)
    stored = C.flush_usage(r, usage).where(X.record_number("id") % 3 == 0)
    mixed = r.join(stored.select("id"), "id", "left_anti").select(*r.columns).unionByName(stored)
    u = F.col("provenance.usage")
    return C.flush_usage(mixed, usage).select("id", u["retrieved"].alias("retrieved"), u["pushed"].alias("pushed"), u["confirmed_helpful"].alias("confirmed_helpful"), u["last_hit"].alias("last_hit"))


QUERIES = {f.__name__: f for f in (corpus_files, osv_advisories, run_manifests, queue_entries, stream_queue_drain, changed_records, flush_usage)}

_PATH = f"'experience/2024/' || substr({Q.rid('doc_id')}, 5) || '-' || source || '.md'"
SQL = {
    "corpus_files": f"""SELECT {_PATH} AS path, CASE WHEN c = 0 THEN 'missing leading front matter fence' WHEN c = 4 THEN 'unterminated front matter fence' WHEN b = '' THEN 'narrative body must be non-empty'
        WHEN c = 3 THEN 'front matter is not valid YAML' WHEN c = 1 THEN 'unknown key surprise' WHEN c = 2 THEN 'invalid: schema_version' WHEN c = 5 THEN 'invalid: kind'
        ELSE {Q.rid('doc_id')} || '|' || CASE WHEN c = 6 THEN 'on|1.10' ELSE source || '|2.0' END || '|' || length(b) END AS outcome, c = 2 AND b <> '' AS critical
      FROM (SELECT *, doc_id % 8 AS c, {Q.utrim('text')} AS b FROM documents)""",
    "osv_advisories": "SELECT 'GHSA-' || p_partkey AS id, CAST(1 AS BIGINT) AS blocks, p_name AS package FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0",
    "run_manifests": f"SELECT 'run-' || o_custkey AS run_id, 'promote' AS stage, o_custkey % 2 = 0 AS anomaly, {Q.rid('o_orderkey')} AS id, lower(o_orderpriority) AS outcome FROM orders",
    "queue_entries": "SELECT CAST(item_id AS VARCHAR) AS session_id, 'me' AS author, CASE WHEN item_id % 9 = 0 THEN 2 ELSE length(text) END AS chars, true AS readable FROM benchmark",
    "stream_queue_drain": f"""WITH q AS (SELECT *, item_id % 9 = 0 OR {Q.utrim('text')} = '' AS blank, length(text) % 3 = 0 AS bad FROM benchmark)
      SELECT DISTINCT 'processed' AS part, ({Q.words('text')})[1] AS key, CAST(1 AS BIGINT) AS n FROM q WHERE NOT blank AND NOT bad
      UNION ALL SELECT 'dead', 'unprocessable', count(*) FROM q WHERE NOT blank AND bad HAVING count(*) > 0 UNION ALL SELECT 'queued', 'blank', count(*) FROM q WHERE blank HAVING count(*) > 0
      UNION ALL SELECT 'alert', CASE WHEN count(*) FILTER (NOT blank) >= 5 AND count(*) FILTER (NOT blank AND bad) / count(*) FILTER (NOT blank) > 0.2 THEN 'true' ELSE 'false' END, count(*) FILTER (NOT blank AND bad) FROM q""",
    "changed_records": f"WITH {Q.CORPUS} SELECT id, CASE WHEN doc_id % 4 = 0 THEN title || '!' ELSE title END AS title FROM corpus WHERE doc_id % 4 = 0 OR doc_id % 10 = 0",
    "flush_usage": f"""WITH {Q.CORPUS}, u AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'view') AS retrieved, count(*) FILTER (event_type = 'click') AS pushed,
        count(*) FILTER (event_type = 'purchase') AS confirmed_helpful, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_hit FROM events GROUP BY 1)
      SELECT id, retrieved, pushed, confirmed_helpful, last_hit FROM corpus JOIN u ON {Q.rid('k')} = id WHERE doc_id % 3 <> 0""",
}
