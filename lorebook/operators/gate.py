"""The push gate: which queries carry a discriminative signal, and what they may inject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .retrieval import (
    MAX_K,
    CorpusIndex,
    as_phrase,
    bm25_topk,
    doc_freq,
    fingerprint_match,
    phrase_hits,
    served_records,
)

# Fixed values of the gate.
PUSH_FLOOR = 3.0
PUSH_MAX_DF = 3
MIN_CORROBORATING = 2
COMMON_RATIO = 0.10


def ecosystem_names(applies_to: DataFrame, records: DataFrame) -> DataFrame:
    """(word): lower-cased ecosystem labels of validated records."""
    validated = records.where(F.col("status") == "validated").select("record_id")
    return (
        applies_to.where(F.col("ecosystem") != "")
        .join(validated, "record_id", "left_semi")
        .select(F.lower("ecosystem").alias("word"))
        .distinct()
    )


def build_idf(docs: DataFrame, max_words: int | None = None) -> DataFrame:
    """(word, df): documents per distinct token; the ``max_words`` most frequent when given.

    Tokens are distinct inside the row before exploding, so counts combine map-side.
    """
    words = docs.select(F.explode_outer(F.array_distinct(X.fields(F.lower("text")))).alias("word")).where(X.has_alnum(F.col("word")))
    counted = words.groupBy("word").agg(F.count("*").alias("df"))
    return counted if max_words is None else counted.orderBy(F.col("df").desc(), "word").limit(max_words)


def globally_common(tokens: DataFrame, idf: DataFrame, total, ratio: float = COMMON_RATIO) -> DataFrame:
    """Adds ``common``: the token's document share exceeds ``ratio``; unknown words are not common.

    ``total`` is a number or a scalar column.
    """
    total = total if not isinstance(total, (int, float)) else F.lit(total)
    known = idf.select(F.lower("word").alias("token"), F.col("df").alias("_df")).groupBy("token").agg(F.max("_df").alias("_df"))
    # A lookup per distinct token, so that a hot token is not a hot join key.
    shares = (
        tokens.select("token").distinct().join(known, "token").withColumn("_n", total)
        .where((F.col("_n") > 0) & (F.col("_df") / F.col("_n") > ratio))
        .select("token", F.lit(True).alias("common"))
    )
    return tokens.join(shares, "token", "left").withColumn(
        "common", F.coalesce("common", F.lit(False))
    )


def gate_tokens(queries: DataFrame, stoplist: DataFrame, cap: int | None = None) -> DataFrame:
    """(query_id, token, pos): the distinct tokens outside the stoplist, or the first ``cap`` of them.

    Tokens keep their punctuation: 'cache,' is not the stop word 'cache'.
    """
    tokens = queries.select("query_id", F.posexplode_outer(X.query_tokens(F.lower("text"))).alias("pos", "token")).where(F.col("token").isNotNull())
    first = tokens.groupBy("query_id", "token").agg(F.min("pos").alias("pos"))
    kept = first.join(stoplist.select(F.col("word").alias("token")).distinct(), "token", "left_anti")
    if cap is None:
        return kept.select("query_id", "token", "pos")
    w = Window.partitionBy("query_id").orderBy("pos")
    return kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("query_id", "token", "pos")


def discriminative_tokens(
    queries: DataFrame,
    index: CorpusIndex,
    idf: DataFrame,
    total,
    stoplist: DataFrame,
    importers: Sequence[str] = (),
    max_df: int = PUSH_MAX_DF,
    cap: int | None = None,
) -> DataFrame:
    """(query_id, token, pos, phrase, df, common): tokens found in 1..max_df eligible records.

    ``common`` marks the ones dropped by the global frequency check alone.
    """
    stop = stoplist.select(F.lower("word").alias("word")).unionByName(ecosystem_names(index.applies_to, index.records))
    scanned = gate_tokens(queries, stop, cap).withColumn("phrase", as_phrase(F.col("token"))).where(F.col("phrase") != "")
    scanned = cut_lineage(scanned)
    eligible = served_records(index, eligible_importers=importers)
    df = doc_freq(index.tokens, scanned, eligible).where(F.col("df") <= max_df)
    return globally_common(scanned.join(df, "phrase"), idf, total).select(
        "query_id", "token", "pos", "phrase", "df", "common"
    )


def corroborate(hits: DataFrame, query_tokens: DataFrame, index: CorpusIndex, min_tokens: int = MIN_CORROBORATING) -> DataFrame:
    """Hits whose record contains at least ``min_tokens`` distinct tokens of its query."""
    hits = cut_lineage(hits)
    # Stored, as it is read twice, and a stop list behind it reads the whole corpus.
    asked = cut_lineage(query_tokens.select("query_id", "token", "phrase").join(hits.select("query_id").distinct(), "query_id", "left_semi"))
    found = phrase_hits(index.tokens, asked, among=hits).select("phrase", "record_id")
    backed = (
        asked.join(hits.select("query_id", "record_id"), "query_id")
        .join(found, ["phrase", "record_id"])
        .groupBy("query_id", "record_id")
        .agg(F.countDistinct("token").alias("tokens"))
        .where(F.col("tokens") >= min_tokens)
    )
    return hits.join(backed.select("query_id", "record_id"), ["query_id", "record_id"], "left_semi")


def push_gate(
    queries: DataFrame,
    index: CorpusIndex,
    idf: DataFrame,
    total,
    stoplist: DataFrame,
    importers: Sequence[str] = (),
    floor: float = PUSH_FLOOR,
    repo: str | None = None,
) -> DataFrame:
    """One trace row per query: (query_id, path, tokens, idf_filtered, served, count).

    ``queries`` is (query_id, text, error_trigger).  Paths: fingerprint (exact match, which
    bypasses the gate and its eligibility rule), closed (no discriminative token), single
    (one token on a prompt trigger), retrieved (the gate opened; ``served`` may be empty).
    """
    # Small per-query tables that later steps read several times are cut to durable storage.
    exact = cut_lineage(fingerprint_match(queries, index.fingerprints, served_records(index), MAX_K, repo))
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    checked = cut_lineage(discriminative_tokens(rest, index, idf, total, stoplist, importers))
    tokens = checked.where(~F.col("common"))
    summary = checked.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("common"), F.struct("pos", "token")))), lambda t: t["token"]
        ).alias("tokens"),
        F.count(F.when(F.col("common"), 1)).alias("idf_filtered"),
    )
    opened = (
        rest.join(summary, "query_id")
        .where((F.size("tokens") >= MIN_CORROBORATING) | (F.col("error_trigger") & (F.size("tokens") >= 1)))
        .select("query_id", F.array_join("tokens", " ").alias("text"), "error_trigger")
    )
    hits = cut_lineage(bm25_topk(opened, index.tokens, MAX_K, floor, served_records(index, eligible_importers=importers)))
    errors = opened.where("error_trigger").select("query_id")
    prompt_hits = hits.join(errors, "query_id", "left_anti")
    served = hits.join(errors, "query_id", "left_semi").unionByName(
        corroborate(prompt_hits, tokens, index).select(*hits.columns)
    )
    both = exact.select("query_id", "rank", "record_id", "score").unionByName(served)
    lists = both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id", "score"))).alias("served"))
    n = F.coalesce(F.size("tokens"), F.lit(0))
    bypass = F.coalesce("bypass", F.lit(False))
    path = (
        F.when(bypass, "fingerprint")
        .when(n == 0, "closed")
        .when(~F.col("error_trigger") & (n < MIN_CORROBORATING), "single")
        .otherwise("retrieved")
    )
    none = F.array().cast("array<struct<rank:int,record_id:string,score:double>>")
    return (
        queries.join(exact.select("query_id", F.lit(True).alias("bypass")).distinct(), "query_id", "left")
        .join(summary, "query_id", "left")
        .join(lists, "query_id", "left")
        .select(
            "query_id",
            path.alias("path"),
            F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
            F.coalesce("idf_filtered", F.lit(0)).alias("idf_filtered"),
            F.coalesce("served", none).alias("served"),
        )
        .withColumn("count", F.size("served"))
    )
