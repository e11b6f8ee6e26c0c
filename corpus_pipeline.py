"""A training corpus from ``documents``: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebook.llm import bpe, mixing, nearcopies, substring, toxicity
from lorebook.llm.shared import documents, fresh, settled, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row: that with the least id.

    Linked are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, and those
    whose SimHash fingerprints op3 links.  Documents without words are one group.  Null ids come
    last; rows of one id are told apart by the hash of their text, then by their place.
    """
    row = fresh(docs, "row")

    def kept() -> DataFrame:
        numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        tags = nearcopies.tag(numbered, row)
        roots = nearcopies.near_groups(tags, numbered.select(F.col(row).alias("row"), "text"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text").alias("h"), "row").alias("order")
        rows = numbered.select(F.col(row).alias("row"), "doc_id", "text").select("row", order).join(tags.select("row", "sid"), "row")
        rooted = rows.join(roots, "sid", "left")
        leads = rooted.groupBy(F.coalesce("root", "sid")).agg(F.min("order").alias("order")).select(F.col("order.row").alias(row))
        return numbered.join(leads, row, "left_semi").select(*docs.columns)

    # What the search stores is as large as the documents, so it goes before the next stage.
    return settled(kept)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; what is emptied by that goes."""
    return substring.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the Pareto sample of their source takes them."""
    return mixing.repeat_by_copies(docs, mixing.pareto_mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, per row."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash and shingle near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("source mix", mix_sources),
    ("byte-level BPE", tokenize),
]

# Learned scores, fingerprint components and token ids can't be expressed in SQL; the stages are
# tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
