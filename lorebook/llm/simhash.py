"""Near-duplicate groups from 64-bit SimHash fingerprints, searched with BK-trees.

Fingerprints within ``RADIUS`` bits agree in at least 6 of 8 bytes, so every choice of 6 bytes
is a shard key: two linked fingerprints meet in one shard at least.  A shard leaves 16 bits
free and so holds at most 65,536 different fingerprints whatever the data; its BK-tree is built
and searched inside the task that owns it.  No fingerprint passes through the driver.
Equal fingerprints are collapsed first; a shard reports each member's link to its local group,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, documents, few_rows, stored

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCKS = 8


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half the shingles' XXH64."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        h = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + step))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        ids, texts = b.column(0), b.column(1)
        yield pa.record_batch([ids, pa.array((simhash(t.as_py()) for t in texts), pa.int64())], ["doc_id", "fp"])


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most ``radius`` bits away; only edges d - radius .. d + radius are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            for k in range(max(0, d - radius), d + radius + 1):
                if k in edges:
                    stack.append(edges[k])
        return found


def local_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the groups of one shard: (value, least value of its group)."""
    mask, tree = (1 << 64) - 1, BKTree()
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ordered = sorted(values)
    for i, v in enumerate(ordered):
        for hit in tree.within(v & mask, radius):
            a, b = root(i), root(hit)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v & mask)
    return [(v, ordered[root(i)]) for i, v in enumerate(ordered) if root(i) != i]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [x for shard in b.column(0).to_pylist() for x in local_links(shard)]
        yield pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def shard_keys(fp: str, blocks: int = BLOCKS, radius: int = RADIUS):
    """All (choice, bits of the chosen blocks) of a fingerprint column."""
    width, keys = 64 // blocks, []
    for choice, left_out in enumerate(combinations(range(blocks), radius)):
        mask = sum(((1 << width) - 1) << (width * b) for b in range(blocks) if b not in left_out)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(choice).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join every group of the different fingerprints of ``classes`` (fp)."""
    shards = (
        classes.select("fp", F.explode(shard_keys("fp")).alias("k"))
        .groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    )
    return shards.select("fps").mapInArrow(_shard_links, "a bigint, b bigint")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other.  A null doc_id is
    never a component's id unless all its members' ids are null.  Repeated rows share a
    component.  Empty input: empty result.  Other columns are not read.
    """
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint"))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(classes)
    roots = connected_components(links)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(component, prints["fp"] == component["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
