from __future__ import annotations

import random

from pyspark.sql import functions as F

from lorebook.functions import text as X
from lorebook.functions import versions as V
from lorebook.functions.ranking import bucketed_row_number, distributed_row_number
from lorebook.functions.stats import wilson


def col(df):
    return [r[0] for r in df.collect()]


def test_signature_normalisation_order(spark):
    cases = {
        " Panic 0xDEADBEEF at /usr/lib/x.go:12 ": "panic <addr> at <path>",
        "id 550e8400-e29b-41d4-a716-446655440000": "id <uuid>",
        "commit deadbeefcafe took 42 ms": "commit <hex> took <num> ms",
        "fts5 and utf8 stay, modernc.org/sqlite too": "fts5 and utf8 stay, modernc.org/sqlite too",
        "a\t\n b": "a b",
        " /tmp/x": "<path>",
        "12é é12": "<num>é é<num>",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for got, want in df.select(X.normalize_signature("t"), "want").collect():
        assert got == want


def test_normalisation_is_idempotent(spark):
    rng = random.Random(7)
    alphabet = list("ab01 fF/.~-_x\t\n  é:") + ["0x", "deadbeef", "/tmp", " ../", "550e8400-e29b-41d4-a716-446655440000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_signature("t").alias("a"))
    df = df.select("a", X.normalize_signature("a").alias("b"))
    assert df.where("a <> b").collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("Cache, the modernc.org/sqlite — it\x00s !!! É1",)], "t string")
    assert df.select(X.terms("t")).first()[0] == ["cache", "the", "modernc", "org", "sqlite", "it", "s", "é1"]
    assert df.select(X.query_tokens("t")).first()[0] == ["Cache,", "the", "modernc.org/sqlite", "its", "É1"]
    w = spark.createDataFrame([("a b c a b c a b",)], "t string").select(X.words("t").alias("w"))
    assert w.select(X.shingles("w", 3)).first()[0] == ["a b c", "b c a", "c a b"]
    assert w.select(X.shingles("w", 9)).first()[0] == []


def test_version_order_is_total(spark):
    ordered = ["", "0.9", "1.2.0-rc1", "v1.2", "1.2.1", "1.10.0-a", "1.10", "2"]
    df = spark.createDataFrame(list(enumerate(ordered)), "i int, v string")
    got = [r["v"] for r in df.orderBy(V.version_key("v"), "i").collect()]
    assert got == ordered
    same = spark.createDataFrame([("1.2", "v1.2.0+build")], "a string, b string")
    assert same.select(V.version_key("a") == V.version_key("b")).first()[0]


def test_affected_range_bounds(spark):
    rows = [("1.0.0", None, None, True), ("1.0.0-rc1", None, "1.0.0", True), ("1.0.0", None, "1.0.0", False), ("1.0", "1.0.0", "", True), ("0.9", "1.0", None, False)]
    df = spark.createDataFrame(rows, "v string, i string, f string, want boolean")
    assert df.where(V.in_affected_range("v", "i", "f") != F.col("want")).collect() == []


def test_wilson_bounds(spark):
    df = spark.range(0, 21).withColumn("w", wilson(F.col("id"), F.lit(20)))
    for r in df.collect():
        assert 0 <= r["w"]["low"] <= r["w"]["value"] <= r["w"]["high"] <= 1
    zero = spark.range(1).select(wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"]
    assert tuple(zero) == (0.0, 0.0, 0.0)


def test_row_numbers_match_plain_order_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}"), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = {(r["k"], r["o"]): r["n"] for r in bucketed_row_number(df, ["k"], ["o"], F.floor(F.col("o") / 50), "n").collect()}
    for key in {k for k, _ in rows}:
        for n, o in enumerate(sorted(o for k, o in rows if k == key), 1):
            assert got[(key, o)] == n
    flat = {r["o"]: r["n"] for r in distributed_row_number(df, "o", "n").collect()}
    assert flat == {i: i + 1 for i in range(3000)}
