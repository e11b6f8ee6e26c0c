from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from lorebook.llm.revisits import canonical_url, resolve_revisits
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, url string, captured_at timestamp, kind string, digest string, headers map<string,string>"
START = datetime(2024, 1, 1, tzinfo=UTC)


def brute(rows):
    out = {}
    for i, url, t, kind, digest, headers in rows:
        h = headers or {}
        if kind == "response":
            out[i] = ("full", i)
            continue
        earlier = [r for r in rows if r[3] == "response" and url and t and r[1] == url and r[2] and (r[2], r[0]) < (t, i)]
        if not earlier:
            out[i] = ("orphan", None)
            continue
        r = max(earlier, key=lambda x: (x[2], x[0]))
        o = r[5] or {}
        checks = [(digest, r[4]), ((h.get("etag") or "").removeprefix("W/") or None, (o.get("etag") or "").removeprefix("W/") or None), (h.get("last-modified"), o.get("last-modified"))]
        same = [a == b for a, b in checks if a is not None and b is not None]
        out[i] = ("unchecked", None) if not same else ("resolved", r[0]) if all(same) else ("mismatch", None)
    return out


def test_against_a_scan_of_all_captures(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        url = rng.choice(["hot.example/a"] * 4 + [f"h{k}.example/x" for k in range(20)] + [None])
        t = None if rng.random() < 0.02 else START + timedelta(seconds=rng.randrange(3_000))
        etag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        headers = None if rng.random() < 0.1 else {k: v for k, v in (("etag", etag), ("content-length", "5"), ("last-modified", rng.choice([None, "m"]))) if v}
        rows.append((i, url, t, rng.choice(["response", "revisit", "revisit"]), rng.choice([None, "d1", "d1"]), headers))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _at", "'x' as status", "2 as _end")
    for ranges in (1, 64, 4096):
        assert {r.record_id: (r.status, r.response_id) for r in resolve_revisits(df, ranges).collect()} == brute(rows)
    assert resolve_revisits(df.limit(0)).count() == 0


def test_headers_are_merged_where_permitted(spark):
    rows = [
        (1, "http://www.A.example:80/p/?utm_source=f&b=2&a=1#top", START, "response", "d", {"etag": '"1"', "content-length": "9", "date": "one", "server": "s"}),
        (2, "https://a.example/p?a=1&b=2", START + timedelta(days=2), "revisit", None, {"etag": 'W/"1"', "content-length": "0", "date": "two", "set-cookie": "c"}),
        (2, "https://a.example/p?a=1&b=2", START + timedelta(days=2), "revisit", None, {"etag": 'W/"1"', "content-length": "0", "date": "two", "set-cookie": "c"}),
    ]
    got = [r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect() if r.kind == "revisit"]
    assert len(got) == 2
    for r in got:
        assert (r.status, r.response_id, r.digest) == ("resolved", 1, "d")
        assert r.headers == {"etag": 'W/"1"', "content-length": "9", "date": "two", "server": "s"}


def test_canonical_urls(spark):
    cases = {"http://WWW.x.org/": "x.org", "https://x.org:443/A/b/?": "x.org/A/b", "x.org/a?c&b=1&&utm_x=2": "x.org/a?b=1&c", "": "", None: None, "ftp://y.org:21/q#f?z=1": "y.org:21/q"}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert [r.c for r in df.select(canonical_url("url").alias("c")).collect()] == list(cases.values())
    assert df.select(F.count("*")).first()[0] == 6
