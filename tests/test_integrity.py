from __future__ import annotations

from pyspark.sql import functions as F

from lorebook.operators import ingest as I


def test_integrity_is_checked_in_parts_of_bounded_size(spark, monkeypatch, capsys):
    monkeypatch.setattr(I, "TASK_ROWS", 10, raising=False)
    # Ids 0 and 1 twice; every tenth names a successor, half of which are absent; repro files up to 249 exist.
    records = spark.range(302).select(
        F.concat(F.lit("i"), (F.col("id") % 300).cast("string")).alias("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.struct(F.when(F.col("id") % 10 == 5, F.concat(F.lit("i"), (F.col("id") + 150).cast("string"))).alias("superseded_by")).alias("provenance"),
        F.struct(F.concat(F.lit("f"), F.col("id").cast("string")).alias("repro"), F.lit(None).cast("array<struct<path:string>>").alias("repros")).alias("guard"),
    )
    files = spark.range(500).select(F.concat(F.lit("f"), (F.col("id") % 250).cast("string")).alias("path"))
    out = I.integrity_check(records, files)
    want = {("i0", "duplicate_id", "2"), ("i1", "duplicate_id", "2")}
    want |= {(f"i{i}", "dangling_superseded_by", f"i{i + 150}") for i in range(5, 302, 10) if i + 150 >= 300}
    want |= {(f"i{i % 300}", "missing_repro", f"f{i}") for i in range(250, 302)}
    assert {tuple(r) for r in out.collect()} == want
    out.explain()
    # 500 rows of the larger table in parts of 10.
    assert capsys.readouterr().out.count(", 50), REPARTITION_BY_NUM") >= 3
