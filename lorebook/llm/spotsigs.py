"""Document fingerprints from SpotSigs.

Every occurrence of a common word is an anchor; with the chain of the next content words (common
words are skipped) it forms a signature.  A document's fingerprint is the set of its
signatures' hashes.  Sets are partitioned by length so that those of a given Jaccard similarity
lie in one partition or in neighbouring ones, and are compared only if their lengths allow it.

Only built-in expressions are used.  Words stay in arrays, so fingerprints need no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, ranked, stored

CHAIN = 3
THRESHOLD = 0.8
_LEAST = -(1 << 63)
# Common words of the four languages, as anchors.
ANCHORS = tuple(
    sorted(
        set(
            "the of and to a in is that for it with as was on be are by this not from or an at have has"
            " der die das und in den zu ist von mit dem nicht ein eine als auf für im es auch an des sich"
            " le la les de des du et en un une que qui est pour dans par sur au il pas plus avec ce"
            " el los las y en un una que es por con para del se no lo su al como más o".split()
        )
    )
)


def _is_anchor(words: Column):
    return lambda i: F.get(words, i).isin(*ANCHORS)


def _chain(words: Column, content: Column):
    """Hash of the j-th anchor, at place i, and its chain: i - j content words stand before it."""

    def chain(i: Column, j: Column) -> Column:
        k = i - j
        hashed = F.xxhash64(F.get(words, i), *[F.get(content, k + c) for c in range(CHAIN)])
        return F.when(k + CHAIN <= F.size(content), hashed)

    return chain


def signature_sets(df: DataFrame, **texts: str) -> DataFrame:
    """``df`` with a sorted array of signature hashes for each ``name=text column`` given.

    A text without an anchor that is followed by enough content words is one signature of its own;
    the empty text has none.  Texts must not be null.
    """
    keep = df.columns
    for name, text in texts.items():
        words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        df = df.withColumn(f"{name}_words", words)
    plain = [F.col(f"`{c}`") for c in keep]
    split = []
    for name in texts:
        w = F.col(f"{name}_words")
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        split += [
            w,
            F.filter(w, lambda x: ~x.isin(*ANCHORS)).alias(f"{name}_content"),
            F.filter(places, _is_anchor(w)).alias(f"{name}_at"),
        ]
    df = df.select(*plain, *split)
    sets = []
    for name, text in texts.items():
        w, content = F.col(f"{name}_words"), F.col(f"{name}_content")
        found = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.col(f"{name}_at"), _chain(w, content)))))
        alone = F.array(F.xxhash64(F.lit("whole"), F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(F.col(text))))
        sets.append(
            F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.when(F.size(found) > 0, found).otherwise(alone)).alias(name)
        )
    return df.select(*plain, *sets)


def fingerprint(signatures: str) -> Column:
    """A set of signatures as a string: its sorted hashes, 16 hexadecimal digits each."""
    return F.array_join(F.transform(F.col(signatures), lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets with a Jaccard similarity of ``threshold`` or more differ by one partition at most."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def pruned_jaccard(a: str, b: str, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 1 for two empty ones; 0 without looking at their members where
    their lengths rule out ``threshold``."""
    p, q = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    exact = common.cast("double") / (p + q - common)
    return F.when((p == 0) & (q == 0), 1.0).when(F.least(p, q) < F.ceil(F.greatest(p, q) * threshold), 0.0).when(F.least(p, q) == 0, 0.0).otherwise(exact)


def similar_fingerprints(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) for pairs of different signature sets of ``docs`` (doc_id, text), each
    named by the least doc_id that has it.

    Signatures are ordered from rare to common; two similar sets share one of the first
    n - ceil(threshold * n) + 1 of each, so frequent signatures don't meet.  Sets meet in their
    length partition and the next one only.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(signature_sets(texts, sigs="text").where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("id")).where("id is not null"))
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = stored(each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    # A signature of one document can't be shared, but takes its place in the order: first.
    shared = each.join(rarity, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("order"))
    left = prefix - (F.col("n") - F.size("order"))
    keys = (
        shared.where(left > 0).select("id", "n", F.explode(F.slice("order", F.lit(1), left.cast("int"))).alias("o"))
        .select("id", "n", F.col("o.sig").alias("sig"), length_partition(F.col("n"), threshold).alias("part"))
    )
    other = keys.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    able = (F.col("n2") <= F.col("n")) & (F.col("n2") >= F.ceil(F.col("n") * threshold)) & ((F.col("n2") < F.col("n")) | (F.col("id2") < F.col("id")))
    pairs = keys.join(other, ["sig", "part"]).where(able).select("id", "id2").distinct()
    one = sets.select("id", F.col("sigs").alias("x"))
    two = sets.select(F.col("id").alias("id2"), F.col("sigs").alias("y"))
    verified = pairs.join(one, "id").join(two, "id2").withColumn("similarity", pruned_jaccard("x", "y", threshold))
    return verified.where(F.col("similarity") >= threshold).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "similarity")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and their
    likeness to each other and to the next document's.

    The edited text has its last quarter of code points replaced by the first as many (or all) of
    the next document.  Null texts are empty ones.  The next document is that of the next
    different (id, text) by id, null ids first and texts of one id by their hash; the first
    follows the last.  Repeated rows give repeated results.  Empty input: empty result.  Other
    columns are not read.

    Plan: a narrow table of (id, hash, length) is ranked and gives each document's
    predecessor; texts are shuffled once by (id, hash), and the opening that the predecessor
    needs goes to its place with the fingerprint.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.col("doc_id").isNull().cast("int").alias("null_id"),
        F.xxhash64(text).alias("h"), text.alias("text"),
    )
    key = ["id", "null_id", "h"]
    narrow = rows.select(*key, F.char_length("text").alias("n")).groupBy(*key).agg(F.first("n").alias("n"))
    order = stored(ranked(narrow, [F.col("null_id").desc(), F.col("id").asc(), F.col("h").asc()], "r"))
    count = max(order.count(), 1)
    before = order.select(
        *[F.col(k).alias(f"{k}_before") for k in key], F.floor(F.col("n") / 4).cast("int").alias("need"),
        F.pmod(F.col("r") + 1, F.lit(count)).alias("r"),
    )
    previous = stored(order.join(before, "r").select(*key, "need", *[f"{k}_before" for k in key]))
    placed = rows.join(previous, key)
    opening = (
        signature_sets(placed.select(*[f"{k}_before" for k in key], "text", F.substring("text", F.lit(1), F.col("need")).alias("opening")), next_sigs="text")
        .groupBy(*[F.col(f"{k}_before").alias(k) for k in key]).agg(F.first("opening").alias("opening"), F.first("next_sigs").alias("next_sigs"))
    )
    n = F.char_length("text")
    both = rows.join(opening, key).select(
        F.when(F.col("null_id") == 0, F.col("id")).alias("doc_id"), "text", n.cast("long").alias("n_chars"), "next_sigs",
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("opening")).alias("edited"),
    )
    signed = signature_sets(both, sigs="text", edited_sigs="edited")
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        pruned_jaccard("sigs", "edited_sigs").alias("near_edited"), pruned_jaccard("sigs", "next_sigs").alias("near_next"),
        length_partition(F.size("sigs")).alias("length_partition"),
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
