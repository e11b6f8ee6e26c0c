"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are collapsed first.  A set's MinHash signature is cut into bands, and sets that agree
in a band are candidates; a pair of similarity 0.8 agrees in none of the 40 bands of 6 values with
a probability of 5e-6, one of 0.85 with 3e-9.  Candidates are confirmed on their whole sets.

Pairs of a band are never all made.  First come rounds of stars: every set of a band meets the band's
most central one (that meets most others in all its bands), and again the most central one of what stays apart.
Then, against the lead s of a band, two sets x and y of different groups can only be similar if they
share more than s explains,

    |x & y| <= |x & s| + |(x - s) & (y - s)|     and     9 |x & y| >= 4 (|x| + |y|),

so y is looked up through the rarest shingles that x has beyond s, as many as can't all be missed.  A
set whose own edits no other one has shares none, and so costs nothing.  Sets that lie almost wholly
inside a longer lead are the one case in which no further shingle is needed; these meet what
their size allows.  All of it is exact: no candidate pair that is similar is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, few_rows, settled, stored
from .simhash import fingerprint_links, simhash

WORDS = 5
BANDS, PER_BAND = 40, 6
# Least similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)

_RNG = np.random.default_rng(5)
_PLACE, _FACTOR, _SHIFT = (_RNG.integers(0, 1 << 64, n, np.uint64) for n in (WORDS, BANDS * PER_BAND, BANDS * PER_BAND))
_PLACE, _FACTOR = _PLACE | np.uint64(1), _FACTOR | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different hashes of the text's five-word shingles; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    sums = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        sums += h[i : len(words) - k + 1 + i] * _PLACE[i]
    return np.unique((sums ^ (sums >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(hashes: np.ndarray, step: int = 512) -> list[int]:
    """A 64-bit key for each band of the signature; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * PER_BAND, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), step):
        np.minimum(least, (_FACTOR[:, None] * hashes[None, at : at + step] + _SHIFT[:, None]).min(1), out=least)
    raw, width = least.tobytes(), 8 * PER_BAND
    return [_signed(xxhash.xxh64_intdigest(raw[width * b : width * (b + 1)], b)) for b in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets, as the bytes of their sorted hashes, are at least ``LEAST`` similar."""
    up, down = LEAST
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * down >= (len(x) + len(y) - both) * up


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        prints, sids, bands = [], [], []
        for t in b.column(1).to_pylist():
            hashes = shingle_set(t)
            prints.append(simhash(t))
            sids.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes())))
            bands.append(band_keys(hashes))
        more = [pa.array(prints, pa.int64()), pa.array(sids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.record_batch([b.column(0), *more], ["row", "fp", "sid", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        yield pa.record_batch([b.column(0), pa.array((shingle_set(t.as_py()).tobytes() for t in b.column(1)), pa.binary())], ["sid", "hashes"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        keep = pa.array((similar(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)), pa.bool_())
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(keep)


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, sid, n, inter, beyond): a set's size, what it shares with the lead, and its other shingles."""
    for b in few_rows(batches):
        sizes, shared, others = [], [], []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            s, own = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            beyond = np.setdiff1d(own, s, assume_unique=True)
            sizes.append(len(own))
            shared.append(len(own) - len(beyond))
            others.append(beyond.view(np.int64))
        more = [pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(others, pa.list_(pa.int64()))]
        yield pa.record_batch([b.column(0), b.column(1), *more], ["lead", "sid", "n", "inter", "beyond"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs of set ids with their sets.  A set that many pairs share is sent to 16 shares of them."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(16)).alias("share"))
    left = salted.select("a", "share").distinct().join(sets.toDF("a", "x"), "a")
    return salted.join(sets.toDF("b", "y"), "b").join(left, ["a", "share"]).select("a", "b", "x", "y")


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """(k, sid, degree, root) of the bands whose sets are not all in one group yet."""
    roots = connected_components(links)
    grouped = members.join(roots, members["sid"] == roots["node"], "left").select("k", "sid", "degree", F.coalesce("root", "sid").alias("root"))
    mixed = grouped.groupBy("k").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("k")
    return stored(grouped.join(mixed, "k", "left_semi"))


def _leads(grouped: DataFrame) -> DataFrame:
    """(k, lead, at): the most central set of each band, and its group."""
    top = grouped.groupBy("k").agg(F.max(F.struct("degree", "sid", "root")).alias("m"))
    return top.select("k", F.col("m.sid").alias("lead"), F.col("m.root").alias("at"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _pairs_beyond(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups that may be similar, by what they share beyond their band's lead."""
    met = grouped.join(_leads(grouped), "k").select("lead", "at", "sid", "root").distinct()
    met = stored(met)
    parts = _with_sets(met.select(F.col("lead").alias("a"), F.col("sid").alias("b")), sets).mapInArrow(
        _beyond, "lead bigint, sid bigint, n bigint, inter bigint, beyond array<bigint>"
    )
    sized = stored(parts.join(met, ["lead", "sid"]))
    up, down = LEAST
    low = sized.groupBy("lead").agg(F.min("n").alias("low"))
    # Least overlap with any partner that is not too small for the whole similarity.
    least = F.ceil(F.lit(up) * (F.col("n") + F.greatest("low", F.ceil(F.col("n") * up / down))) / (up + down))
    apart = stored(sized.where("root != at").join(low, "lead").withColumn("need", least - F.col("inter")))
    each = sized.select("lead", "sid", "root", F.explode("beyond").alias("h"))
    # Only shingles of several groups can link two of them.
    common = stored(
        each.groupBy("lead", "h").agg(F.count("*").alias("df"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("lead", "h", "df")
    )
    able = stored(each.join(common, ["lead", "h"]))
    rare = (
        able.join(apart.select("lead", "sid", "need"), ["lead", "sid"])
        .groupBy("lead", "sid", "root", "need").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
        .withColumn("take", F.size("hs") - F.greatest(F.col("need"), F.lit(1)) + 1).where("take > 0")
        .select("lead", F.col("sid").alias("x"), F.col("root").alias("rx"), F.explode(F.slice("hs", F.lit(1), F.col("take").cast("int"))["h"]).alias("h"))
    )
    shared = rare.join(able.select("lead", "h", F.col("sid").alias("y"), "root"), ["lead", "h"]).where("rx != root")
    within = apart.where("need <= 0").select("lead", F.col("sid").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), "inter")
    inside = within.join(sized.select("lead", F.col("sid").alias("y"), "root", "n"), "lead").where(
        (F.col("rx") != F.col("root")) & ((F.col("nx") + F.col("n")) * up <= F.col("inter") * (up + down))
    )
    return _pairs(shared.select("x", "y").union(inside.select("x", "y")), "x", "y")


def jaccard_links(tags: DataFrame, texts: DataFrame, rounds: int = 3) -> DataFrame:
    """Links (a, b) of set ids that join every group of similar sets.

    ``tags`` is (row, sid, bands), ``texts`` (row, text) with the same rows; texts of one sid have one
    set.  Null and empty texts have no bands and so no links; without any two sets in one band the
    result is empty.  Repeated rows are one set.  Other columns are not read.
    """
    spark = tags.sparkSession
    first = stored(tags.groupBy("sid").agg(F.min("row").alias("row")))
    keys = tags.where(F.size("bands") > 0).join(first.select("row"), "row", "left_semi")
    each = keys.select("sid", F.explode("bands").alias("k"))
    several = each.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    met = each.join(several, "k")
    degree = met.groupBy("sid").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = stored(met.select("k", "sid").join(degree, "sid"))
    wanted = first.join(members.select("sid").distinct(), "sid", "left_semi")
    sets = stored(texts.join(wanted, "row").select("sid", "text").mapInArrow(_sets, "sid bigint, hashes binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(_with_sets(pairs, sets).mapInArrow(_confirmed, "a bigint, b bigint"))

    tried = links = spark.createDataFrame([], "a bigint, b bigint")
    grouped = members.withColumn("root", F.col("sid"))
    for turn in range(rounds):
        leads = _leads(grouped)
        if turn:  # of what is not in the group of the band's lead
            rest = grouped.join(leads, "k").where(F.col("root") != F.col("at")).select("k", "sid", "degree", "root")
            leads = _leads(rest)
        pairs = _pairs(grouped.join(leads, "k").where(F.col("root") != F.col("at")), "sid", "lead")
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        found = confirmed(pairs)
        tried, links = tried.union(pairs), links.union(found)
        if found.isEmpty():
            break
        grouped = _mixed(members, links)
    left = stored(_pairs_beyond(_mixed(members, links), sets).join(tried, ["a", "b"], "left_anti"))
    return links.union(confirmed(left))


def tag(numbered: DataFrame, row: str) -> DataFrame:
    """(row, fp, sid, bands) of each row of ``numbered``, which has a column ``row`` that tells rows apart and
    ``text``: fingerprint, set id and band keys, stored.  A null text counts as empty: fingerprint 0, the
    empty set, no bands.  Other columns are not read."""
    schema = "row bigint, fp bigint, sid bigint, bands array<bigint>"
    return stored(numbered.select(F.col(row).alias("row"), "text").mapInArrow(_tagged, schema))


def near_groups(tags: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, root) for every set id that is linked to another one, by its shingles or because
    fingerprints of its texts are linked as in ``op3_simhash_bktree``; arguments as in ``jaccard_links``
    with ``fp`` in ``tags``.  Set ids without a link are not in it; empty input gives an empty result."""

    def links() -> DataFrame:
        classes = stored(tags.groupBy("fp").agg(F.min("sid").alias("lead")))
        pairs = fingerprint_links(classes)
        linked = pairs.join(classes.toDF("a", "u"), "a").join(classes.toDF("b", "v"), "b").select("u", "v")
        same = tags.select("fp", "sid").join(classes, "fp").where("sid != lead").select("sid", "lead").distinct()
        edges = jaccard_links(tags, texts).union(linked).union(same)
        return connected_components(edges).toDF("sid", "root")

    return settled(links)
