"""Batch retrieval: a table of queries against a corpus index.

Every operator is a query-table x corpus-table job.  The token index keeps one row per
record (arrays of terms per column), so term statistics come from one scan: the query
vocabulary is matched while tokens are exploded, and only matches are shuffled, already
pre-aggregated per (phrase, record).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from . import dense
from .inverted import BM25_B, BM25_K1, MIN_IDF, StoredIndex
from .inverted import DECIMALS as SCORE_DECIMALS
from .records import flatten_records, push_eligible
from .scoring import best_of_records, best_of_stored, entries, gathered, matched, numbered

# Hit limits, floors, scores and fusion constants of retrieval.
MAX_K = 3
DEFAULT_FLOOR = 2.0e-06
FINGERPRINT_SCORE = 1000.0
RRF_K = 60
FUSION_CANDIDATES = 10
DENSE_FLOOR = 0.5
# Whole numbers below this are exact as doubles.
EXACT = 1 << 53


@dataclass
class CorpusIndex:
    """The derived tables of a corpus.

    records       record_id, kind, status, title, summary, path, origin
    fingerprints  fp, scope, record_id
    applies_to    record_id, ecosystem, package
    tokens        record_id, fields (array of term arrays, one per text column), dl; or a stored
                  index of them (:class:`.inverted.StoredIndex`), which look-ups read instead
    vectors       record_id, vec (optional)
    """

    records: DataFrame
    fingerprints: DataFrame
    applies_to: DataFrame
    tokens: DataFrame | StoredIndex
    vectors: DataFrame | None = None


def token_index(texts: DataFrame, columns: Sequence[str] = ("title", "summary", "signatures", "body")) -> DataFrame:
    """(record_id, fields, dl) from one text row per record."""
    out = texts.select(
        "record_id", F.array(*[X.terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]).alias("fields")
    )
    dl = F.aggregate("fields", F.lit(0).cast("bigint"), lambda acc, f: acc + F.size(f))
    return out.withColumn("dl", dl)


def build_index(records: DataFrame, repo: str, vectors: DataFrame | None = None, root: str | None = None) -> CorpusIndex:
    """The tables of a corpus; with ``root``, its tokens as an index stored there."""
    flat, fingerprints, applies_to, texts = flatten_records(records, repo)
    tokens = token_index(texts)
    return CorpusIndex(flat, fingerprints, applies_to, tokens if root is None else StoredIndex.build(tokens, root), vectors)


def postings(tokens: DataFrame) -> DataFrame:
    """(term, record_id, col, pos): the positional view of a token index."""
    cols = tokens.select("record_id", F.posexplode("fields").alias("col", "terms"))
    return cols.select("record_id", "col", F.posexplode("terms").alias("pos", "term")).select(
        "term", "record_id", "col", "pos"
    )


def stack_filter(
    df: DataFrame, applies_to: DataFrame, ecosystem: str | None = None, package: str | None = None
) -> DataFrame:
    """Records with one applies_to row matching the ecosystem and/or package, ignoring case."""
    if not ecosystem and not package:
        return df
    keep = applies_to
    if ecosystem:
        keep = keep.where(F.lower("ecosystem") == ecosystem.lower())
    if package:
        keep = keep.where(F.lower("package") == package.lower())
    return df.join(keep.select("record_id"), "record_id", "left_semi")


def served_records(
    index: CorpusIndex,
    include_quarantined: bool = False,
    ecosystem: str | None = None,
    package: str | None = None,
    eligible_importers: Sequence[str] | None = None,
) -> DataFrame:
    """(record_id) of the records a search may return."""
    statuses = ["validated", *(["quarantined"] if include_quarantined else [])]
    keep = index.records.where(F.col("status").isin(*statuses))
    if eligible_importers is not None:
        keep = keep.where(push_eligible(eligible_importers))
    return stack_filter(keep, index.applies_to, ecosystem, package).select("record_id")


def _among(hits: DataFrame, served: DataFrame | None) -> DataFrame:
    """Keep matches of served records; applied to matches, never to the statistics behind them."""
    return hits if served is None else hits.join(served.select("record_id"), "record_id", "left_semi")


# ---------------------------------------------------------------- exact matches


def fingerprint_match(
    queries: DataFrame, fingerprints: DataFrame, served: DataFrame | None = None, k: int = MAX_K, repo: str | None = None
) -> DataFrame:
    """(query_id, rank, record_id, score): records sharing a fingerprint with the query text.

    Which k records a fingerprint yields does not depend on the query, so every fingerprint
    is reduced to its k lowest ids first; a fingerprint carried by a third of the corpus
    costs no more than any other.
    """
    by_id = Window.partitionBy("fp").orderBy("record_id")
    # Served records first, so that fingerprints of the others need not be computed; their ids are stored,
    # as their size in bytes decides whether they are sent to the texts.
    allowed = fingerprints if served is None else fingerprints.join(cut_lineage(served.select("record_id").distinct()), "record_id", "left_semi")
    best = allowed.select("fp", "record_id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k).drop("n")
    fps = [X.generic_fingerprint("text")]
    if repo:
        fps.append(X.app_fingerprint("text", F.lit(repo)))
    probes = queries.where(~X.is_blank("text")).select("query_id", F.explode(F.array(*fps)).alias("fp"))
    hits = probes.join(best, "fp").select("query_id", "record_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("record_id"))
    return (
        hits.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "record_id", F.lit(FINGERPRINT_SCORE).alias("score"))
    )


# ---------------------------------------------------------------- lexical matches


def as_phrase(token: Column) -> Column:
    """The phrase of one query token: its index terms, space-joined."""
    return F.array_join(X.terms(token), " ")


def _tokens(max_tokens: int | None) -> Column:
    return X.query_tokens("text") if max_tokens is None else F.slice(X.query_tokens("text"), 1, max_tokens)


def query_phrases(queries: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """(query_id, phrase, qtf): the tokens of each query, or its first ``max_tokens``; repeated tokens
    weigh repeatedly."""
    return (
        queries.select("query_id", F.explode_outer(F.transform(_tokens(max_tokens), as_phrase)).alias("phrase"))
        .where(F.col("phrase") != "")
        .groupBy("query_id", "phrase")
        .agg(F.count("*").alias("qtf"))
    )


def phrase_hits(
    tokens: DataFrame | StoredIndex, phrases: DataFrame, carry: Sequence[str] = (), among: DataFrame | None = None
) -> DataFrame:
    """(phrase, record_id, tf, *carry): occurrences of each phrase within single columns, in all records or
    those of ``among``.

    Single terms are matched while the token arrays are exploded.  A longer phrase is a chain
    of bigrams: its j-th bigram at position p votes for a start at p - j, and a start with all
    votes is an occurrence.  The distinct phrases are stored first, so that their size in bytes
    decides between a broadcast and a shuffle on the term with adaptive splitting of hot terms.
    """
    if isinstance(tokens, StoredIndex):
        return tokens.hits(phrases, among).select("phrase", "record_id", "tf", *carry)
    if among is not None:
        tokens = tokens.join(among.select("record_id").distinct(), "record_id", "left_semi")
    # Outer explodes: the inner form would add a non-empty test that tokenises every text again.
    wanted = cut_lineage(phrases.select("phrase").distinct().withColumn("words", F.split("phrase", " ")).withColumn("m", F.size("words")))
    longest = wanted.agg(F.max("m").alias("m")).first()["m"] or 1
    carried = [F.max(c).alias(c) for c in carry]
    terms = tokens.select("record_id", *carry, F.explode_outer(F.flatten("fields")).alias("term"))
    singles = wanted.where(F.col("m") == 1).select(F.col("phrase").alias("term"))
    hits = (
        terms.join(singles, "term")
        .groupBy(F.col("term").alias("phrase"), "record_id")
        .agg(F.count("*").alias("tf"), *carried)
    )
    if longest < 2:
        return hits
    chain = wanted.where(F.col("m") > 1).select(
        "phrase", (F.col("m") - 1).alias("votes"), F.posexplode(X.ngrams(F.col("words"), 2)).alias("j", "bigram")
    )
    bigrams = tokens.select("record_id", *carry, F.posexplode_outer("fields").alias("col", "f")).select(
        "record_id", *carry, "col", F.posexplode_outer(_bigrams(F.col("f"))).alias("pos", "bigram")
    )
    starts = (
        bigrams.join(chain, "bigram")
        .groupBy("phrase", "record_id", "col", (F.col("pos") - F.col("j")).alias("start"))
        .agg(F.count("*").alias("seen"), F.max("votes").alias("votes"), *carried)
        .where(F.col("seen") == F.col("votes"))
    )
    longer = starts.groupBy("phrase", "record_id").agg(F.count("*").alias("tf"), *carried)
    return hits.unionByName(longer)


def _bigrams(f: Column) -> Column:
    n = F.size(f) - 1
    return F.when(
        n >= 1, F.zip_with(F.slice(f, F.lit(1), n), F.slice(f, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    ).otherwise(F.array().cast("array<string>"))


def doc_freq(tokens: DataFrame | StoredIndex, phrases: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """(phrase, df): distinct served records containing each phrase (absent phrases missing).

    Only served records are read: no statistics of the others enter the count."""
    if isinstance(tokens, StoredIndex):
        return tokens.doc_freq(phrases, served)
    among = None if served is None else cut_lineage(served.select("record_id").distinct())
    return phrase_hits(tokens, phrases, among=among).groupBy("phrase").agg(F.count("*").alias("df"))


def doc_freqs(tokens: DataFrame | StoredIndex, phrases: DataFrame, **served: DataFrame) -> DataFrame:
    """(phrase, <name> ...): for each table of served records, how many of them contain each phrase, by one
    count of occurrences (phrases that none contains are missing)."""
    marks = [df.select("record_id", *[F.lit(name == other).alias(other) for other in served]) for name, df in served.items()]
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    every = cut_lineage(every.groupBy("record_id").agg(*[F.bool_or(name).alias(name) for name in served]))
    hits = phrase_hits(tokens, phrases, among=every).join(every, "record_id")
    return hits.groupBy("phrase").agg(*[F.count(F.when(F.col(name), 1)).alias(name) for name in served])


def lexical_match(queries: DataFrame, tokens: DataFrame | StoredIndex, k: int = FUSION_CANDIDATES, max_tokens: int | None = None) -> DataFrame:
    """(query_id, rank, record_id, matched, tf): the k records with most of a query's phrases, then
    most occurrences, then the lowest id."""
    wanted = query_phrases(queries, max_tokens)
    codes = numbered(wanted.select("phrase").distinct())
    wanted = cut_lineage(wanted.join(codes, "phrase"))
    records = gathered(phrase_hits(tokens, codes).join(codes, "phrase").select("record_id", "code", "tf", F.lit(1).cast("bigint").alias("dl")))
    # Both counts as one whole number: phrases weigh more than all occurrences together.
    tf = records.agg(F.max(F.array_max("tfs"))).first()[0] or 0
    asked = wanted.groupBy("query_id").agg(F.sum("qtf").alias("all"), F.count("*").alias("n")).agg(F.max("all"), F.max("n")).first()
    unit = 1 << (tf * (asked[0] or 0)).bit_length()
    if unit * ((asked[1] or 0) + 1) >= EXACT:
        matched = entries(records).join(wanted, "code").groupBy("query_id", "record_id").agg(F.count("*").alias("matched"), F.sum(F.col("qtf") * F.col("tf")).alias("tf"))
    else:
        both = lambda first, second: F.explode(F.array(F.struct((F.col("code") * 2).alias("code"), first.alias("v")), F.struct((F.col("code") * 2 + 1).alias("code"), second.alias("v")))).alias("e")
        weights = wanted.select("query_id", both(F.lit(float(unit)), F.col("qtf").cast("double"))).select("query_id", "e.code", F.col("e.v").alias("weight"), F.lit(1.0).alias("avgdl"))
        codes = F.concat(F.transform("codes", lambda c: c * 2), F.transform("codes", lambda c: c * 2 + 1))
        tfs = F.concat(F.transform("tfs", lambda _: F.lit(1).cast("bigint")), F.col("tfs"))
        given = cut_lineage(records.select("record_id", "dl", codes.alias("codes"), tfs.alias("tfs")))
        score = best_of_records(given, weights, lambda tf, dl, avgdl: tf, k, 0.0, 0)
        whole = F.col("score").cast("bigint")
        matched = score.select("query_id", "record_id", F.floor(F.col("score") / unit).cast("bigint").alias("matched"), (whole % unit).alias("tf"))
    best = Window.partitionBy("query_id").orderBy(F.col("matched").desc(), F.col("tf").desc(), "record_id")
    return matched.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "record_id", "matched", "tf")


@dataclass
class _Matches:
    """Durable inputs of scoring: served records (record_id, dl, codes, tfs) with the phrases they hold, as
    numbers, and weights (query_id, code, weight, avgdl)."""

    records: DataFrame
    weights: DataFrame


def _matches(queries: DataFrame, tokens: DataFrame | StoredIndex, served: DataFrame | None, max_tokens: int | None) -> _Matches:
    # These tables are read several times: query phrases are small, and the records stand for a
    # scan of the whole corpus.
    wanted = query_phrases(queries, max_tokens)
    codes = numbered(wanted.select("phrase").distinct())
    wanted = cut_lineage(wanted.join(codes, "phrase"))
    records = gathered(phrase_hits(tokens, codes, ["dl"]).join(codes, "phrase"))
    held = lambda df: df.select(F.explode("codes").alias("code"))
    df = held(records).groupBy("code").agg(F.count("*").alias("df"))
    if served is not None:
        # Statistics are of all records; from here on only phrases of served ones can score.
        records = cut_lineage(_among(records, served))
        df = df.join(held(records).distinct(), "code", "left_semi")
    if isinstance(tokens, StoredIndex):
        n, average = tokens.totals()
        totals = F.struct(F.lit(n).alias("n"), F.lit(average).alias("avgdl"))
    else:
        totals = tokens.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("t")).scalar()
    weights = cut_lineage(
        wanted.join(df, "code")
        .withColumn("t", totals)
        .withColumn("idf", F.ln((F.col("t.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .withColumn("idf", F.when(F.col("idf") > 0, F.col("idf")).otherwise(F.lit(MIN_IDF)))
        .select("query_id", "code", (F.col("qtf") * F.col("idf")).alias("weight"), F.col("t.avgdl").alias("avgdl"))
    )
    return _Matches(records, weights)


def _part(tf, dl, avgdl):
    """BM25 contribution of one phrase of weight 1 to one record, of columns or arrays."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def bm25_scores(
    queries: DataFrame, tokens: DataFrame | StoredIndex, served: DataFrame | None = None, max_tokens: int | None = None
) -> DataFrame:
    """(query_id, record_id, score) of every served record matching a query.

    Statistics (N, df, average length) cover all records; ``served`` only limits what is returned.
    """
    m = _matches(queries, tokens, served, max_tokens)
    part = F.col("weight") * _part(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return _rounded(entries(m.records).join(m.weights, "code").groupBy("query_id", "record_id").agg(F.sum(part).alias("score")))


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("query_id", "record_id", F.round("score", SCORE_DECIMALS).alias("score"))


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, record_id, score): the k best per query, score descending, then id.

    The rank filter is pruned inside each map task before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "record_id", "score")
    )


def apply_floor(scored: DataFrame, floor: float | None) -> DataFrame:
    """Drop scores below the floor: unset means the default, zero or less turns it off."""
    floor = DEFAULT_FLOOR if floor is None else floor
    return scored.where(F.col("score") >= floor) if floor > 0 else scored


def bm25_topk(
    queries: DataFrame,
    tokens: DataFrame | StoredIndex,
    k: int = MAX_K,
    floor: float | None = None,
    served: DataFrame | None = None,
    max_tokens: int | None = None,
) -> DataFrame:
    """The k best records per query by Okapi BM25."""
    if isinstance(tokens, StoredIndex):
        least = DEFAULT_FLOOR if floor is None else floor
        return top_ranked(apply_floor(tokens.topk(query_phrases(queries, max_tokens), k, least, served), floor), k)
    # Texts lie by their query before they are split, so that no token is shuffled.
    told = X.seamed_phrases("text") if max_tokens is None else F.transform(_tokens(max_tokens), as_phrase)
    phrases = queries.select("query_id", "text").repartition("query_id").select("query_id", told.alias("phrases"))
    keep = None
    if served is not None:
        # Statistics are of all records; only served ones are scored.
        tokens = tokens.join(cut_lineage(served.select("record_id").distinct()).withColumn("served", F.lit(True)), "record_id", "left")
        keep = F.col("served")
    asked, records, df, n, average = matched(phrases, tokens, keep)
    asked = asked.select("query_id", F.lit(average).alias("avgdl"), "codes", F.col("qtfs").alias("weights"))
    least = DEFAULT_FLOOR if floor is None else floor
    scored = _rounded(best_of_stored(records, asked, _part, k, least, SCORE_DECIMALS, df, _idf(n)))
    return top_ranked(apply_floor(scored, floor), k)


def _idf(n: int) -> Callable[[np.ndarray], np.ndarray]:
    def idf(df: np.ndarray) -> np.ndarray:
        value = np.log((n - df + 0.5) / (df + 0.5))
        return np.where(value > 0, value, MIN_IDF)

    return idf


# ---------------------------------------------------------------- dense matches


def dense_match(
    queries: DataFrame,
    vectors: DataFrame,
    floor: float = DENSE_FLOOR,
    k: int = FUSION_CANDIDATES,
    served: DataFrame | None = None,
    cell: int | None = None,
) -> DataFrame:
    """(query_id, rank, record_id, score): exact cosine top-k from the floor on.

    ``queries`` is (query_id, vec), ``vectors`` is (record_id, vec); unequal lengths and zero
    vectors never reach a positive floor.  See :mod:`.dense` for cells of about ``cell`` vectors.
    """
    corpus = vectors if served is None else vectors.join(served, "record_id", "left_semi")
    return dense.nearest(queries, corpus, floor, k, cell)


def embedding_text(records: DataFrame) -> DataFrame:
    """(record_id, text, hash): what gets embedded; the body is left out."""
    opt = lambda c: F.nullif(F.col(c), F.lit(""))
    text = X.utrim(
        F.concat_ws(
            "\n", "title", opt("symptom.summary"), F.col("symptom.error_signatures"),
            opt("resolution.root_cause"), opt("resolution.fix"),
        )
    )
    return (
        records.select(F.col("id").alias("record_id"), text.alias("text"))
        .where(F.col("text") != "")
        .withColumn("hash", F.sha2("text", 256))
    )


def embedding_cache_miss(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(hash, text): each distinct text that has no cached vector, once."""
    distinct = texts.groupBy("hash").agg(F.min("text").alias("text"))
    return distinct.join(cache.select("hash"), "hash", "left_anti")


def embed_missing(missing: DataFrame, embed) -> DataFrame:
    """(hash, vec): run a user-supplied batch function (list of texts -> list of vectors)."""

    def run(batches):
        for batch in batches:
            batch = batch.assign(vec=list(embed(batch["text"].tolist())))
            yield batch[["hash", "vec"]]

    return missing.mapInPandas(run, "hash string, vec array<float>")


# ---------------------------------------------------------------- composition


def rrf_fuse(*lists: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, rank, record_id, score, source): reciprocal-rank fusion of ranked lists.

    ``source`` is the position of the first list a record appears in.
    """
    tagged = [
        ranked.select("query_id", "record_id", "rank", F.lit(i).alias("source")) for i, ranked in enumerate(lists)
    ]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionByName(more)
    fused = union.groupBy("query_id", "record_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))), 12).alias("score"),
        F.min("source").alias("source"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id")
    return fused.withColumn("rank", F.row_number().over(w)).select(
        "query_id", "rank", "record_id", "score", "source"
    )


def _tiers(exact: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """Exact hits first, then the rest, each record once, k per query."""
    both = exact.select("query_id", "record_id", "score", F.lit("fingerprint").alias("matched"), F.lit(0).alias("tier"), "rank").unionByName(
        rest.select("query_id", "record_id", "score", "matched", F.lit(1).alias("tier"), "rank")
    )
    once = both.groupBy("query_id", "record_id").agg(F.min(F.struct("tier", "rank", "score", "matched")).alias("h"))
    w = Window.partitionBy("query_id").orderBy("h.tier", "h.rank")
    return (
        once.withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= k)
        .select("query_id", F.col("n").alias("rank"), "record_id", "h.score", "h.matched")
    )


def clamp_k(k: int) -> int:
    return k if 1 <= k <= MAX_K else MAX_K


def search(
    queries: DataFrame,
    index: CorpusIndex,
    k: int = MAX_K,
    floor: float | None = None,
    repo: str | None = None,
    max_tokens: int | None = None,
    **stack,
) -> DataFrame:
    """(query_id, rank, record_id, score, matched): fingerprint hits, then BM25 fill, at most three."""
    k = clamp_k(k)
    served = served_records(index, **stack)
    exact = fingerprint_match(queries, index.fingerprints, served, k, repo)
    exact = cut_lineage(exact)
    # A query that exact matches have filled takes no lexical ones.
    filled = exact.groupBy("query_id").count().where(F.col("count") >= k)
    open_ = queries.join(filled, "query_id", "left_anti")
    lexical = bm25_topk(open_, index.tokens, k, floor, served, max_tokens).withColumn("matched", F.lit("lexical"))
    return _tiers(exact, lexical, k)


def retrieve_fused(
    queries: DataFrame,
    index: CorpusIndex,
    k: int = MAX_K,
    floor: float | None = None,
    dense_floor: float = DENSE_FLOOR,
    repo: str | None = None,
    max_tokens: int | None = None,
    **stack,
) -> DataFrame:
    """Fingerprint hits, then BM25 and dense fused by reciprocal rank; ``queries`` has (query_id, text, vec).

    A query without a vector falls back to the lexical ranking (and its BM25 scores).
    """
    k = clamp_k(k)
    served = served_records(index, **stack)
    exact = fingerprint_match(queries, index.fingerprints, served, k, repo)
    # Stored, as queries with and without a vector read it.
    lexical = cut_lineage(bm25_topk(queries, index.tokens, FUSION_CANDIDATES, floor, served, max_tokens))
    with_vec = queries.where(F.coalesce(F.size("vec"), F.lit(0)) > 0)
    has_vec = with_vec.select("query_id")
    dense = dense_match(with_vec, index.vectors, dense_floor, FUSION_CANDIDATES, served)
    fused = rrf_fuse(lexical.join(has_vec, "query_id", "left_semi"), dense)
    fused = fused.withColumn("matched", F.when(F.col("source") == 0, "lexical").otherwise("dense"))
    plain = lexical.join(has_vec, "query_id", "left_anti").withColumn("matched", F.lit("lexical"))
    return _tiers(exact, fused.drop("source").unionByName(plain), k)


def assess_novelty(queries: DataFrame, index: CorpusIndex, floor: float | None = None, repo: str | None = None, **stack) -> DataFrame:
    """(query_id, novelty, candidates): known (exact hit), similar (any hit) or novel."""
    hits = search(queries, index, MAX_K, floor, repo, **stack)
    item = F.struct("rank", "record_id", "score", "matched")
    per_query = hits.groupBy("query_id").agg(
        F.bool_or(F.col("matched") == "fingerprint").alias("known"), F.array_sort(F.collect_list(item)).alias("hits")
    )
    known = F.coalesce("known", F.lit(False))
    empty = F.array().cast("array<struct<rank:int,record_id:string,score:double,matched:string>>")
    hits_or_none = F.coalesce("hits", empty)
    return (
        queries.select("query_id").distinct()
        .join(per_query, "query_id", "left")
        .select(
            "query_id",
            F.when(known, "known").when(F.col("hits").isNotNull(), "similar").otherwise("novel").alias("novelty"),
            F.when(known, F.filter(hits_or_none, lambda h: h["matched"] == "fingerprint"))
            .otherwise(hits_or_none)
            .alias("candidates"),
        )
    )
