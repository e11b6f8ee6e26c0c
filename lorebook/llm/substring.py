"""Removal of repeated passages by seed and extend.

1. Seeds.  Each document's word k-grams are winnowed: the least hash of every run of
   ``WINDOW - SEED_WORDS + 1`` k-grams is an anchor, so every repeat of ``WINDOW`` words holds a
   common anchor.  Documents are joined on anchors that occur in more than one of them.
2. Extension, both ways.  An anchor is extended to the ``WINDOW - SEED_WORDS`` words on either
   side.  Occurrences with the same extension form a class; all but its first document repeat
   the whole extension, with one row each and no pairs.  Where an anchor has several classes, the
   first document of each is compared window by window: a window belongs to the anchor that its
   own words give it, and windows with equal words are grouped, again without pairs.
3. Overlapping matches are merged into maximal repeats, whose words are removed.

Texts are shuffled once, and those that take part in a repeat a second time.  What an anchor or a
window is joined with is stored first, so that the join has plain exchanges on both sides and
adaptive execution can split a passage that many documents share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, few_rows, stored

WINDOW = 50
SEED_WORDS = 10

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2^64
_EMPTY = hashlib.sha256(b"").hexdigest()
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Rolling:
    """Hashes of all runs of words of one document in O(1) each."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * _powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, n + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of words[start:end] that does not depend on the place, well mixed."""
        x = (self.sums[end] - self.sums[start]) * self.back[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def anchors_of_runs(hashes: np.ndarray, run: int) -> np.ndarray:
    """Place of the leftmost least hash of every ``run`` consecutive hashes: the anchor that a window
    of these k-grams has by its own words, whatever surrounds it."""
    if len(hashes) < run:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(1)
    return least + np.arange(len(least))


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """All anchors."""
    return np.unique(anchors_of_runs(hashes, run))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _seeds(window: int, k: int) -> Callable:
    reach = window - k

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            counts, sha, places, anchors, contexts = [], [], [], [], []
            for t in b.column(2):
                words = _words(t.as_py())
                n = len(words)
                counts.append(n)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if n < window:
                    p = h = c = np.zeros(0, np.int64)
                else:
                    r = Rolling(words)
                    at = np.arange(n - k + 1)
                    grams = r.runs(at, at + k)
                    p = winnow(grams, reach + 1)
                    left, right = np.maximum(p - reach, 0), np.minimum(p + k + reach, n)
                    h = grams[p].view(np.int64)
                    c = (r.runs(left, right) + (p - left).astype(np.uint64) * np.uint64(_BASE) + (right - p).astype(np.uint64)).view(np.int64)
                places.append(p.astype(np.int32))
                anchors.append(h)
                contexts.append(c)
            yield pa.record_batch(
                [
                    b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(sha, pa.string()),
                    pa.array(places, pa.list_(pa.int32())), pa.array(anchors, pa.list_(pa.int64())), pa.array(contexts, pa.list_(pa.int64())),
                ],
                ["doc_id", "tk", "n_words", "sha", "places", "anchors", "contexts"],
            )

    return seeds


def _windows(window: int, k: int) -> Callable:
    """The windows whose own anchor has several extensions, with the text for the last step."""
    reach = window - k

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            anchors, starts, hashes = [], [], []
            for t, places in zip(b.column(2), b.column(4), strict=True):
                if places.is_valid:
                    words = _words(t.as_py())
                    r, at = Rolling(words), np.arange(len(words) - k + 1)
                    grams = r.runs(at, at + k)
                    own = anchors_of_runs(grams, reach + 1)
                    start = np.flatnonzero(np.isin(own, places.values.to_numpy()))
                    anchor = grams[own[start]].view(np.int64)
                    hashed = r.runs(start, start + window).view(np.int64)
                else:
                    anchor = start = hashed = np.zeros(0, np.int64)
                anchors.append(anchor)
                starts.append(start.astype(np.int32))
                hashes.append(hashed)
            yield pa.record_batch(
                [
                    b.column(0), b.column(1), b.column(2), b.column(3),
                    pa.array(anchors, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["doc_id", "tk", "text", "whole", "anchor", "start", "hash"],
            )

    return windows


def _cut(window: int, k: int) -> Callable:
    """Remove what the matches cover."""
    reach = window - k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            removed, sha, kept = [], [], []
            for t, whole, starts in zip(b.column(2), b.column(3), b.column(4), strict=True):
                words = _words(t.as_py())
                n = len(words)
                p, s = np.array(whole.as_py() or [], np.int64), np.array(starts.as_py() or [], np.int64)
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.concatenate([np.maximum(p - reach, 0), s]), 1)
                np.add.at(change, np.concatenate([np.minimum(p + k + reach, n), s + window]), -1)
                covered = np.cumsum(change)[:n] > 0
                left = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                removed.append(int(covered.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "tk", "n_removed", "kept_sha256", "kept"],
            )

    return cut


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = SEED_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, tk, n_words, n_removed, kept_sha256 [, kept]) for every row of ``docs`` (doc_id, text).

    A word goes if one of the ``window``-word runs that cover it also starts in a document with
    a smaller id.  Texts of fewer words, null ones included, keep all.  A null id is neither
    smaller nor larger than any; rows that share an id don't repeat each other, and ``tk`` (a
    hash of the text) tells them apart.  ``kept`` is null where nothing was removed.  Empty
    input: empty result.  Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("tk"), text.alias("text"))
    seeds = stored(
        keyed.mapInArrow(
            _seeds(window, k),
            "doc_id bigint, tk bigint, n_words bigint, sha string, places array<int>, anchors array<bigint>, contexts array<bigint>",
        )
    )
    at = (
        seeds.where(F.col("doc_id").isNotNull() & (F.size("places") > 0))
        .select("doc_id", "tk", F.explode(F.arrays_zip("places", "anchors", "contexts")).alias("s"))
        .select("doc_id", "tk", F.col("s.places").alias("place"), F.col("s.anchors").alias("anchor"), F.col("s.contexts").alias("context"))
    )
    shared = stored(at.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"))
    # Documents of equal words are repeats as a whole: the first stands for them from here on.
    first = stored(
        seeds.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    )
    copies = stored(seeds.select("doc_id", "tk", "sha").join(first, "sha").where(F.col("_first") < F.col("doc_id")).select("doc_id", "tk").distinct())
    hits = stored(at.join(shared, "anchor").join(copies, ["doc_id", "tk"], "left_anti"))
    classes = stored(hits.groupBy("anchor", "context").agg(F.min("doc_id").alias("first_id")))
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"))
    whole = (
        hits.join(classes, ["anchor", "context"]).where(F.col("first_id") < F.col("doc_id"))
        .groupBy("doc_id", "tk").agg(F.collect_list("place").alias("whole"))
    )
    open_ = (
        hits.join(classes, ["anchor", "context"]).where(F.col("first_id") == F.col("doc_id"))
        .join(several, "anchor", "left_semi")
        .groupBy("doc_id", "tk").agg(F.collect_list("place").alias("open"))
    )
    needed = whole.join(open_, ["doc_id", "tk"], "full")
    parts = stored(
        keyed.join(needed, ["doc_id", "tk"]).select("doc_id", "tk", "text", "whole", "open")
        .mapInArrow(_windows(window, k), "doc_id bigint, tk bigint, text string, whole array<int>, anchor array<bigint>, start array<int>, hash array<bigint>")
    )
    each = parts.select("doc_id", "tk", F.explode(F.arrays_zip("anchor", "start", "hash")).alias("w")).select(
        "doc_id", "tk", F.col("w.anchor").alias("anchor"), F.col("w.start").alias("start"), F.col("w.hash").alias("hash")
    )
    least = stored(each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").drop("_hi"))
    found = (
        each.join(least, ["anchor", "hash"]).where(F.col("_lo") < F.col("doc_id"))
        .groupBy("doc_id", "tk").agg(F.collect_list("start").alias("starts"))
    )
    changed = (
        parts.join(found, ["doc_id", "tk"], "left")
        .where(F.col("whole").isNotNull() | F.col("starts").isNotNull())
        .select("doc_id", "tk", "text", "whole", "starts")
        .mapInArrow(_cut(window, k), "doc_id bigint, tk bigint, n_removed bigint, kept_sha256 string, kept string")
    )
    if not with_text:
        changed = changed.drop("kept")
    changed = changed.dropDuplicates(["doc_id", "tk"]) if with_text else changed.distinct()
    c = changed.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "n_removed", "kept_sha256", *["kept"] * with_text)
    own = seeds.select("doc_id", "tk", "n_words", "sha")
    nothing = [F.lit("").alias("kept")] * with_text
    gone = copies.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.lit(None).cast("long").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"), *nothing)
    c = c.union(gone).withColumn("_changed", F.lit(True))
    out = own.join(c, (own["doc_id"] == c["_id"]) & (own["tk"] == c["_tk"]), "left")
    removed = F.when(F.col("_changed"), F.coalesce("n_removed", "n_words")).otherwise(0).cast("long")
    return out.select("doc_id", "tk", "n_words", removed.alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *["kept"] * with_text)


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """``docs`` without repeated passages and with n_chars to match; documents of which nothing
    is left are dropped, those without repeats stay as they are."""
    cut = repeated_passages(docs, window, k, with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "tk"])
    same = (docs["doc_id"] == cut["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cut["tk"])
    some_left = F.coalesce(cut["n_removed"] < cut["n_words"], F.lit(True))
    out = {c: docs[c] for c in docs.columns}
    out["text"] = F.coalesce(cut["kept"], docs["text"])
    if "n_chars" in out:
        length = F.length(cut["kept"]).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(cut["kept"].isNull(), docs["n_chars"]).otherwise(length)
    return docs.join(cut, same, "left").where(some_left).select(*[c.alias(name) for name, c in out.items()])


def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("tk")
