"""Points in ranges by aligned cells, and the dependency audit on top of them."""

from __future__ import annotations

import random

from lorebook.functions import versions as V
from lorebook.operators import advisories as A
from pyspark.sql import functions as F


def hits(points, ranges):
    return sorted((p, r) for p, g, k in points for r, h, lo, hi in ranges if g == h and (lo is None or k >= lo) and (hi is None or k < hi))


def got(spark, points, ranges):
    p = spark.createDataFrame(points, "point bigint, grp string, key bigint").repartition(5)
    r = spark.createDataFrame(ranges, "range_id bigint, grp string, low bigint, high bigint")
    return sorted(map(tuple, A.in_ranges(p, r).collect()))


def test_random_points_and_ranges(spark):
    rng = random.Random(2)
    end = lambda: rng.choice([None, rng.randint(-5, 40)])
    points = [(i, rng.choice("abbbc"), rng.randint(-3, 35)) for i in range(400)]
    ranges = [(i, rng.choice("abbbd"), end(), end()) for i in range(120)]
    assert got(spark, points, ranges) == hits(points, ranges)


def test_empty_sides(spark):
    one, two = [(1, "a", 1)], [(1, "a", None, None)]
    assert got(spark, one, two) == [(1, 1)]
    assert got(spark, [], two) == [] == got(spark, one, []) == got(spark, [], [])


def test_one_group_with_many_of_both_gives_its_hits_only(spark):
    """40,000 versions and 5,000 short ranges of one package: 200 million pairs, of which a few thousand are hits."""
    rng = random.Random(6)
    points = [(i, "hot", i) for i in range(40_000)]
    ranges = [(i, "hot", a, a + rng.randint(0, 3)) for i, a in enumerate(rng.choices(range(40_000), k=5_000))]
    want = sorted((v, i) for i, _, a, b in ranges for v in range(a, min(b, 40_000)))
    assert got(spark, points, ranges) == want
    spans = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1 << 40), (5, 6), (1, 1_000_000), (7, 7))])).alias("s")).select("s.*")
    cells = [r.c for r in spans.select(A._cells(F.col("a").cast("bigint"), F.col("b").cast("bigint")).alias("c")).collect()]
    assert [len(c) for c in cells][:2] == [1, 1] and len(cells[2]) <= 40 and cells[3] == []
    assert sum(1 << x.level for x in cells[2]) == 999_999


def test_audit_of_prereleases_open_ends_and_repeats(spark):
    advisories = spark.createDataFrame(
        [
            ("r1", [" GHSA-aaaa "], [("go", "m", "1.0.0", "1.2.0"), ("npm", "m", None, None), ("Go", "m", "2.0.0-rc1", None)]),
            ("r2", ["note", "CVE-1"], [("go", "m", None, "1.0.0"), ("go", "n", "", "")]),
            ("r3", ["nothing"], [("go", "m", None, None)]),
        ],
        "id string, sigs array<string>, a array<struct<ecosystem: string, package: string, introduced: string, fixed: string>>",
    ).select(
        "id", F.struct(F.col("sigs").alias("error_signatures")).alias("symptom"),
        F.transform("a", lambda a: F.struct(a["ecosystem"].alias("ecosystem"), a["package"].alias("package"), F.struct(a["introduced"], a["fixed"]).alias("versions"))).alias("applies_to"),
    )
    deps = [("m", v) for v in ("v0.9.0", "v1.0.0-beta", "1.0", "v1.1.9+build", "v1.2.0-rc.1", "1.2.0", "v2.0.0-rc0", "v2.0.0", "v1.0.0", "v1.0.0", "odd", None)]
    deps += [("n", "v3"), ("x", "v1"), (None, "v1")]
    frame = spark.createDataFrame(deps, "path string, version string")
    rows = sorted(tuple(r) for r in A.advisory_audit(frame, advisories).collect() if r.version is not None)
    entries = [("r1", "GHSA-aaaa", "m", "1.0.0", "1.2.0"), ("r1", "GHSA-aaaa", "m", "2.0.0-rc1", ""), ("r2", "CVE-1", "m", "", "1.0.0"), ("r2", "CVE-1", "n", "", "")]
    pairs = spark.createDataFrame([(p, v, *e) for p, v in deps for e in entries if p == e[2] and v is not None], "path string, version string, record_id string, advisory_id string, package string, introduced string, fixed string")
    want = pairs.where(V.in_affected_range("version", "introduced", "fixed")).drop("package")
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 10


def test_audit_parses_each_version_once(spark, monkeypatch):
    seen, find = [], A.in_ranges
    monkeypatch.setattr(A, "in_ranges", lambda points, ranges: seen.append(points) or find(points, ranges))
    deps = spark.createDataFrame([(f"p{i % 7}", f"v{i % 3}.0") for i in range(40)] + [("p0", None)], "path string, version string")
    applies = "array<struct<ecosystem:string,package:string,versions:struct<introduced:string,fixed:string>>>"
    advisories = spark.createDataFrame(
        [("a", (["GHSA-x"],), [("Go", "p0", ("1", None))]), ("b", (["GHSA-y"],), [("Go", "p1", (None, "1"))])],
        f"id string, symptom struct<error_signatures:array<string>>, applies_to {applies}",
    )
    got = sorted((r.path, r.version, r.record_id) for r in A.advisory_audit(deps, advisories).collect() if r.version is not None)
    want = [(f"p{i % 7}", f"v{i % 3}.0", "a" if i % 7 == 0 else "b") for i in range(40) if (i % 7 == 0 and i % 3) or (i % 7 == 1 and i % 3 == 0)]
    assert got == sorted(want)
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
