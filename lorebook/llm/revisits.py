"""Resolution of not-modified revisits in web captures by an as-of join.

A revisit takes the latest earlier full response of the same canonical URL.  Its validators are
checked against that response, and the headers that a not-modified answer may update are laid
over the response's.

Captures are cut into ``RANGES`` time ranges.  A window finds the last response inside each
(URL, range); for the rest, the last response of each (URL, range) is carried over the ranges, a
table with at most ``RANGES`` rows per URL.  A URL with a third of all captures is thus spread
over its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = 4096
# Headers of a not-modified answer that replace those of the stored response.
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: str) -> Column:
    """Host (without www. and default port, lower case), path and sorted query without tracking
    parameters; scheme, fragment and a final slash are dropped.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z]+://", "")
    before = F.split_part(bare, F.lit("?"), F.lit(1))
    host = F.regexp_replace(F.lower(F.split_part(before, F.lit("/"), F.lit(1))), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(before, "^[^/]*", ""), "/+$", "")
    asked = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, "^[^?]*[?]", "")).otherwise(F.lit(""))
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the fresh answer; null maps count as empty."""
    none = F.create_map().cast("map<string,string>")
    given = F.map_filter(F.coalesce(fresh, none), lambda k, v: k.isin(*UPDATED) & v.isNotNull())
    old = F.coalesce(stored, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)


def resolve_revisits(captures: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Every row of ``captures`` (record_id, url, captured_at, kind, digest, headers) as
    (record_id, kind, url_key, status, response_id, digest, headers).

    ``kind`` is response or revisit; ``headers`` maps lower-case names to values.  A response
    answers for itself (status full).  A revisit is resolved if a response of its URL was
    captured earlier (ties by record_id) and the validators both have (digest, ETag without weak
    mark, Last-Modified) agree and at least one can be compared; mismatch if one differs; unchecked
    if none can be compared; orphan without an earlier response or with a null URL or time, which
    precede and follow nothing.  Only resolved revisits take the response's id, digest and merged
    headers.  Repeated rows are each answered.  Other columns are not read.
    """
    rows = captures.select("record_id", "captured_at", "kind", "digest", "headers", canonical_url("url").alias("url_key"))
    span = rows.agg(F.min("captured_at").alias("lo"), F.max("captured_at").alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    seconds = F.unix_micros("captured_at")
    if lo is None:
        at = F.lit(0).cast("long")
    else:
        first, last = (F.unix_micros(F.lit(t)) for t in (lo, hi))
        at = F.floor((seconds - first).cast("double") * ranges / (last - first + 1)).cast("long")
    ready = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    placed = rows.where(ready).withColumn("_at", at)
    answer = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "digest", "headers"))
    inside = Window.partitionBy("url_key", "_at").orderBy("captured_at", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_near", F.last(answer, ignorenulls=True).over(inside))
    # The last response of each range, then of all ranges before.
    ends = placed.groupBy("url_key", "_at").agg(
        F.max_by(answer, F.when(F.col("kind") == "response", F.struct("captured_at", "record_id"))).alias("_end")
    )
    earlier = Window.partitionBy("url_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select(F.col("url_key").alias("_url"), F.col("_at").alias("_range"), F.last("_end", ignorenulls=True).over(earlier).alias("_far"))
    found = near.join(far, (near["url_key"] == far["_url"]) & (near["_at"] == far["_range"])).withColumn("_r", F.coalesce("_near", "_far"))
    columns = ["record_id", "kind", "url_key", "digest", "headers"]
    lost = rows.where(~ready).select(*columns, F.lit(None).cast(found.schema["_r"].dataType).alias("_r"))
    both = found.select(*columns, "_r").union(lost)

    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [
        (F.col("digest"), F.col("_r.digest")),
        (weak(F.col("headers")["etag"]), weak(F.col("_r.headers")["etag"])),
        (F.col("headers")["last-modified"], F.col("_r.headers")["last-modified"]),
    ]
    agree = [a == b for a, b in pairs]
    status = (
        F.when(F.col("kind") == "response", "full").when(F.col("_r").isNull(), "orphan")
        .when(~F.least(*[F.coalesce(x, F.lit(True)) for x in agree]), "mismatch")
        .when(F.coalesce(*agree).isNull(), "unchecked").otherwise("resolved")
    )
    done = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "kind", "url_key", "status",
        F.when(F.col("kind") == "response", F.col("record_id")).when(done, F.col("_r.record_id")).alias("response_id"),
        F.when(done, F.col("_r.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merge_headers(F.col("_r.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page (page_id, url, html): its response, and a not-modified revisit.

    Responses come in the order of page_id, ten seconds apart.  Revisits come a tenth of a day
    later or, where the page's checksum starts with 0, a tenth of a day earlier; they carry the
    page's ETag, in weak form where the checksum ends in 0, a new date, and a length that must not
    be merged.
    """
    md5 = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    p = pages.select("page_id", "url", md5.alias("_md5"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("_n"))
    day = lambda s: F.lit(1_700_000_000) + F.col("page_id") * 10 + s
    text = lambda s: s.cast("string")
    shift = F.when(F.col("_md5").startswith("0"), -8_645).otherwise(8_645)
    etag = F.concat(F.when(F.col("_md5").endswith("0"), "W/").otherwise(""), F.lit('"'), F.substring("_md5", 1, 16), F.lit('"'))
    plain = F.concat(F.lit('"'), F.substring("_md5", 1, 16), F.lit('"'))
    one = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds(day(0)).alias("captured_at"), F.lit("response").alias("kind"),
        F.col("_md5").alias("digest"),
        F.create_map(F.lit("content-length"), F.col("_n"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), text(day(0)), F.lit("etag"), plain).alias("headers"),
    )
    two = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(day(shift)).alias("captured_at"), F.lit("revisit").alias("kind"),
        F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), text(day(shift)), F.lit("etag"), etag).alias("headers"),
    )
    return one.union(two)


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as sorted lines of name and value."""
    resolved = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.col("headers")[k]))
    return resolved.select("record_id", "kind", "url_key", "status", "response_id", "digest", F.array_join(lines, "\n").alias("headers"))


SQL = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z]+://', '') AS b FROM pages
), cut AS (
  SELECT page_id, html, split_part(b, '?', 1) AS f,
         CASE WHEN contains(b, '?') THEN regexp_replace(b, '^[^?]*[?]', '') ELSE '' END AS q FROM bare
), keyed AS (
  SELECT page_id, md5(coalesce(html, '')) AS m, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS n,
         regexp_replace(lower(split_part(f, '/', 1)), '^www[.]|:(80|443)$', '', 'g')
         || regexp_replace(regexp_replace(f, '^[^/]*', ''), '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
  FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS kept FROM cut)
), captures AS (
  SELECT page_id * 2 AS record_id, 1700000000 + page_id * 10 AS t, 'response' AS kind, url_key, m AS digest, n,
         '"' || m[1:16] || '"' AS etag FROM keyed
  UNION ALL
  SELECT page_id * 2 + 1, 1700000000 + page_id * 10 + CASE WHEN m LIKE '0%' THEN -8645 ELSE 8645 END, 'revisit', url_key, NULL, '0',
         CASE WHEN m LIKE '%0' THEN 'W/' ELSE '' END || '"' || m[1:16] || '"' FROM keyed
), found AS (
  SELECT c.*, r.record_id AS r_id, r.digest AS r_digest, r.n AS r_n, r.etag AS r_etag,
         row_number() OVER (PARTITION BY c.record_id ORDER BY r.t DESC, r.record_id DESC) AS k
  FROM captures c LEFT JOIN captures r
    ON c.kind = 'revisit' AND r.kind = 'response' AND r.url_key = c.url_key
   AND (r.t < c.t OR (r.t = c.t AND r.record_id < c.record_id))
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN r_id IS NULL THEN 'orphan'
                 WHEN replace(etag, 'W/', '') <> r_etag THEN 'mismatch' ELSE 'resolved' END AS status
  FROM found WHERE k = 1
)
SELECT record_id, kind, url_key, status,
       CASE WHEN kind = 'response' THEN record_id WHEN status = 'resolved' THEN r_id END AS response_id,
       CASE WHEN status = 'resolved' THEN r_digest ELSE digest END AS digest,
       'content-length: ' || CASE WHEN status = 'resolved' THEN r_n ELSE n END
       || CASE WHEN kind = 'response' OR status = 'resolved' THEN chr(10) || 'content-type: text/html' ELSE '' END
       || chr(10) || 'date: ' || t || chr(10) || 'etag: ' || etag AS headers
FROM judged
"""
