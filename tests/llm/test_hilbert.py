from __future__ import annotations

import random
import zlib
from itertools import product

from lorebook.llm.hilbert import hilbert_index, hilbert_shards, write_shards
from pyspark.sql import functions as F


def test_the_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = list(product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(cells, [f"c{i}" for i in range(n)])
        rows = df.withColumn("h", hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect()
        at = {r["h"]: tuple(r[:n]) for r in rows}
        assert sorted(at) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(len(cells) - 1))


def test_shards_slots_and_sizes(spark, docs_of, tmp_path):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 3000), rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["en", "de", None])) for i in range(1013)]
    rows += [(None, None, None, None), (2000, None, "a", "en"), (2000, "x", "a", "en"), (2000, "x", "a", "en")]
    df = docs_of(rows)
    got = hilbert_shards(df).collect()
    assert len(got) == len(rows)
    counts = {s: sorted(r.slot for r in got if r.shard == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    text = dict((r[0], r[1]) for r in rows if r[0] is not None and r[0] < 2000)
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got if r.doc_id in text)
    none = next(r for r in got if r.doc_id is None)
    assert (none.size, none.text_crc32, none.law, none.grown_shard) == (16, 0, "rows", None)
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    unique = df.where("doc_id < 2000")
    write_shards(unique, hilbert_shards(unique), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 1013 and back.select("shard").distinct().count() == 40


def test_fewer_rows_than_shards(spark, docs_of):
    got = hilbert_shards(docs_of([(1, "a"), (2, "b"), (3, "c")])).collect()
    assert sorted(r.slot for r in got) == [0, 0, 0] and len({r.shard for r in got}) == 3
    assert hilbert_shards(docs_of([(1, "a")]).limit(0)).count() == 0
