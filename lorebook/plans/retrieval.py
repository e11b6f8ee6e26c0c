"""Registered queries: retrieval, the push gate and frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gate as G
from ..operators import retrieval as R
from ..session import cut_lineage
from . import sqltext as Q
from .tables import (
    benchmark_queries,
    corpus,
    document_index,
    document_tokens,
    records,
    stored_tokens,
    table,
    turn_queries,
)

IMPORTERS = ("src3", "src7")
STOP_RATIO = 0.5


def _score(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits)).withColumn("rank", F.col("rank").cast("bigint"))


def fingerprint_corpus(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select(
        "doc_id", F.col("line").cast("bigint").alias("line"), X.normalize_signature("text").alias("normalized"),
        X.generic_fingerprint("text").alias("fp"),
    )


def fingerprint_match(s, d):
    c = corpus(s, d)
    queries = c.select(F.posexplode("signatures").alias("line", "text"), "id").select(
        F.concat_ws("#", "id", F.col("line").cast("string")).alias("query_id"), "text"
    )
    fps = c.select(F.explode("signatures").alias("text"), F.col("id").alias("record_id"), "status").select(
        X.generic_fingerprint("text").alias("fp"), "record_id", "status"
    )
    served = c.where(F.col("status") == "validated").select(F.col("id").alias("record_id"))
    return R.fingerprint_match(queries, fps, served).select("query_id", F.col("rank").cast("bigint").alias("rank"), "record_id", "score")


def stack_filter(s, d):
    idx = document_index(s, d, tokens=False)
    return R.stack_filter(idx.records, idx.applies_to, "FR", "SRC4").select("record_id", "kind", "status")


def lexical_match(s, d):
    return R.lexical_match(benchmark_queries(s, d), document_tokens(s, d)).withColumn("rank", F.col("rank").cast("bigint"))


def bm25_topk(s, d):
    return _score(R.bm25_topk(benchmark_queries(s, d), document_tokens(s, d), 3))


def stored_bm25_topk(s, d):
    """The same ranking out of the stored index."""
    return _score(R.bm25_topk(benchmark_queries(s, d), stored_tokens(s, d), 3))


def stored_doc_freq(s, d):
    idx = document_index(s, d, tokens=False)
    return R.doc_freq(stored_tokens(s, d), R.query_phrases(benchmark_queries(s, d)), R.served_records(idx))


def _drafts(s, d):
    """Documents outside the validated corpus, as queries."""
    return corpus(s, d).where(F.col("status") != "validated").select(F.col("id").alias("query_id"), F.col("body").alias("text"))


def search(s, d):
    return _score(R.search(_drafts(s, d), document_index(s, d)))


def assess_novelty(s, d):
    out = R.assess_novelty(_drafts(s, d), document_index(s, d), floor=20.0)
    ids = F.array_join(F.transform("candidates", lambda h: h["record_id"]), ",")
    return out.select("query_id", "novelty", ids.alias("candidates"))


def dense_match(s, d):
    e = table(s, d, "embeddings")
    return _score(
        R.dense_match(
            e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
            e.select(X.record_id("vec_id").alias("record_id"), F.col("embedding").alias("vec")),
            floor=0.3,
        )
    )


def _user_lists(s, d):
    per = table(s, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("record_id")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last")
    )
    by_count = R.top_ranked(per.withColumn("score", F.col("n")), 3)
    by_last = R.top_ranked(per.withColumn("score", F.col("last")), 4)
    return by_count, by_last


def rrf_fuse(s, d):
    return _score(R.rrf_fuse(*_user_lists(s, d)), 9).withColumn("source", F.col("source").cast("bigint"))


def retrieve_fused(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    queries = benchmark_queries(s, d).join(e, "query_id", "left")
    return _score(R.retrieve_fused(queries, document_index(s, d, vectors=True), dense_floor=0.2), 9)


def _idf(s, d):
    return G.build_idf(table(s, d, "documents"))


def _total(s, d):
    return table(s, d, "documents").agg(F.count("*")).scalar()


def _stoplist(s, d, idf=None):
    """Words of more than half of the documents."""
    idf = _idf(s, d) if idf is None else idf
    return idf.withColumn("n", _total(s, d)).where(F.col("df") / F.col("n") > STOP_RATIO).select("word")


def build_idf(s, d):
    return _idf(s, d)


def globally_common(s, d):
    tokens = table(s, d, "conversations").select(
        "conv_id", "turn", F.explode(F.array_distinct(X.query_tokens(F.lower("text")))).alias("token")
    )
    return G.globally_common(tokens, _idf(s, d), _total(s, d))


def ecosystem_names(s, d):
    idx = document_index(s, d, tokens=False)
    return G.ecosystem_names(idx.applies_to, idx.records)


def doc_freq(s, d):
    idx = document_index(s, d)
    phrases = R.query_phrases(turn_queries(s, d))
    df = R.doc_freqs(
        idx.tokens, phrases, df_validated=R.served_records(idx), df_eligible=R.served_records(idx, eligible_importers=IMPORTERS)
    )
    return df.where(F.col("df_validated") > 0)


def discriminative_tokens(s, d):
    idf = cut_lineage(_idf(s, d))
    return G.discriminative_tokens(
        turn_queries(s, d), document_index(s, d), idf, _total(s, d), _stoplist(s, d, idf), IMPORTERS
    ).select("query_id", "token", F.col("pos").cast("bigint").alias("pos"), "phrase", "df", "common")


def corroborate(s, d):
    q = turn_queries(s, d)
    idx = document_index(s, d)
    tokens = G.gate_tokens(q, _stoplist(s, d)).withColumn("phrase", R.as_phrase(F.col("token"))).where(F.col("phrase") != "")
    hits = R.bm25_topk(q, idx.tokens, 3, served=R.served_records(idx))
    return _score(G.corroborate(hits, tokens, idx))


def push_gate(s, d):
    idf = cut_lineage(_idf(s, d))
    out = G.push_gate(turn_queries(s, d), document_index(s, d), idf, _total(s, d), _stoplist(s, d, idf), IMPORTERS)
    return out.select(
        "query_id", "path", F.array_join("tokens", " ").alias("tokens"), F.col("idf_filtered").cast("bigint").alias("idf_filtered"),
        F.array_join(F.transform("served", lambda h: h["record_id"]), ",").alias("served"), F.col("count").cast("bigint").alias("count"),
    )


def embedding_cache_miss(s, d):
    r = records(s, d)
    cache = R.embedding_text(r.where(F.col("status") == "validated")).select("hash")
    return R.embedding_cache_miss(R.embedding_text(r), cache).select("hash", F.length("text").cast("bigint").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        fingerprint_corpus, fingerprint_match, stack_filter, lexical_match, bm25_topk, stored_bm25_topk, stored_doc_freq, search, assess_novelty, dense_match,
        rrf_fuse, retrieve_fused, build_idf, globally_common, ecosystem_names, doc_freq, discriminative_tokens, corroborate,
        push_gate, embedding_cache_miss,
    )
}

_IMP = ", ".join(Q.q(i) for i in IMPORTERS)
ELIGIBLE = f"status = 'validated' AND kind IN ('trap', 'fix') AND lower(author) NOT IN ({_IMP}) AND lower(author) NOT LIKE 'alpha:%'"
VALID = "status = 'validated'"
DRAFTS = "queries AS (SELECT id AS query_id, body AS text FROM corpus WHERE status <> 'validated')"
IDF = f"""idf AS (SELECT word, count(*) AS df FROM (
    SELECT unnest(list_distinct(list_transform(list_filter({Q.fields('text')}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]')), lambda x: lower(x)))) AS word
    FROM documents) GROUP BY word),
  tot AS (SELECT count(*) AS n FROM documents),
  stopl AS (SELECT word FROM idf, tot WHERE df / n > {STOP_RATIO})"""
ECO = "eco AS (SELECT DISTINCT lower(lang) AS word FROM corpus WHERE status = 'validated')"


def _tiers(lex: str, k: int = 3) -> str:
    """hitlist(query_id, rank, record_id, score, matched) of exact and ``lex``(rank, score, matched)."""
    return f"""both_ AS (SELECT query_id, record_id, 1000e0 AS score, 'fingerprint' AS matched, 0 AS tier, rank FROM exact
      UNION ALL SELECT query_id, record_id, score, matched, 1, rank FROM {lex}),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, record_id ORDER BY tier, rank) AS o FROM both_) WHERE o = 1),
  hitlist AS (SELECT * FROM (SELECT query_id, record_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank FROM once)
      WHERE rank <= {k})"""


def gate_ctes(queries: str = "queries") -> str:
    return f"""gtok AS (SELECT query_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (
      SELECT query_id, {Q.query_tokens('lower(text)')} AS l FROM {queries})),
  gfirst AS (SELECT query_id, token, min(pos) AS pos FROM gtok GROUP BY ALL)"""


def gate_scan(stop: str) -> str:
    return f"""gscan AS (SELECT query_id, token, pos, array_to_string({Q.terms('token')}, ' ') AS phrase FROM gfirst WHERE token NOT IN ({stop})),
  gphr AS (SELECT * FROM gscan WHERE phrase <> '')"""


DISC = f"""{gate_ctes()},
  {gate_scan("SELECT lower(word) FROM stopl UNION SELECT word FROM eco")},
  {Q.hits_ctes('gphr', 'g')},
  gdf AS (SELECT phrase, count(*) AS df FROM ghits JOIN corpus USING (record_id) WHERE {ELIGIBLE} GROUP BY phrase HAVING count(*) <= 3),
  disc AS (SELECT query_id, token, pos, phrase, gdf.df AS df, coalesce(idf.df / tot.n > 0.1, false) AS common
      FROM gphr JOIN gdf USING (phrase) LEFT JOIN idf ON idf.word = token, tot)"""

_BM25_TOPK = f"""WITH {Q.CORPUS}, {Q.BENCHMARK_QUERIES}, {Q.document_tokens()}, {Q.bm25_ctes('queries')}
      SELECT query_id, rank, record_id, round(score, 6) AS score FROM top"""

SQL = {
    "stored_bm25_topk": _BM25_TOPK,
    "stored_doc_freq": f"""WITH {Q.CORPUS}, {Q.BENCHMARK_QUERIES}, {Q.document_tokens()}, {Q.phrase_ctes('queries')}
      SELECT phrase, count(*) AS df FROM hits JOIN corpus USING (record_id) WHERE {VALID} GROUP BY phrase""",
    "fingerprint_corpus": f"""SELECT doc_id, line, {Q.norm('text')} AS normalized, {Q.fingerprint('text')} AS fp FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)""",
    "fingerprint_match": f"""WITH {Q.CORPUS},
      ql AS (SELECT id, status, unnest(signatures) AS text, generate_subscripts(signatures, 1) - 1 AS line FROM corpus),
      fp AS (SELECT id, status, text, line, {Q.fingerprint('text')} AS fp FROM ql),
      best AS (SELECT fp, id FROM (SELECT fp, id, row_number() OVER (PARTITION BY fp ORDER BY id) AS n FROM
          (SELECT DISTINCT fp, id FROM fp WHERE status = 'validated')) WHERE n <= 3)
      SELECT a.id || '#' || line AS query_id, row_number() OVER (PARTITION BY a.id, line ORDER BY b.id) AS rank, b.id AS record_id, 1000e0 AS score
      FROM fp a JOIN best b USING (fp) WHERE {Q.utrim('text')} <> ''""",
    "stack_filter": f"WITH {Q.CORPUS} SELECT record_id, kind, status FROM corpus WHERE lang = 'fr' AND source = 'src4'",
    "lexical_match": f"""WITH {Q.CORPUS}, {Q.BENCHMARK_QUERIES}, {Q.document_tokens()}, {Q.phrase_ctes('queries')},
      m AS (SELECT query_id, record_id, count(*) AS matched, CAST(sum(qtf * tf) AS BIGINT) AS tf FROM hits JOIN qphr USING (phrase) GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, tf DESC, record_id) AS rank FROM m) WHERE rank <= 10""",
    "bm25_topk": _BM25_TOPK,
    "search": f"""WITH {Q.CORPUS}, {DRAFTS}, {Q.document_tokens(VALID)}, {Q.fp_ctes('queries')}, {Q.bm25_ctes('queries')},
      lex AS (SELECT *, 'lexical' AS matched FROM top), {_tiers('lex')}
      SELECT query_id, rank, record_id, round(score, 6) AS score, matched FROM hitlist""",
    "assess_novelty": f"""WITH {Q.CORPUS}, {DRAFTS}, {Q.document_tokens(VALID)}, {Q.fp_ctes('queries')}, {Q.bm25_ctes('queries', floor=20.0)},
      lex AS (SELECT *, 'lexical' AS matched FROM top), {_tiers('lex')},
      agg AS (SELECT query_id, bool_or(matched = 'fingerprint') AS known, string_agg(record_id, ',' ORDER BY rank) AS every,
        string_agg(record_id, ',' ORDER BY rank) FILTER (matched = 'fingerprint') AS exact_ids FROM hitlist GROUP BY query_id)
      SELECT query_id, CASE WHEN known THEN 'known' WHEN every IS NOT NULL THEN 'similar' ELSE 'novel' END AS novelty,
        CASE WHEN known THEN exact_ids ELSE coalesce(every, '') END AS candidates FROM queries LEFT JOIN agg USING (query_id)""",
    "dense_match": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      s AS (SELECT a.vec_id AS query_id, {Q.rid('b.vec_id')} AS record_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a, e b)
      SELECT query_id, rank, record_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s WHERE score >= 0.3) WHERE rank <= 10""",
    "rrf_fuse": """WITH per AS (SELECT user_id AS query_id, event_type AS record_id, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
      a AS (SELECT * FROM (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, record_id) AS rank FROM per) WHERE rank <= 3),
      b AS (SELECT * FROM (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY last DESC, record_id) AS rank FROM per) WHERE rank <= 4),
      u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b),
      f AS (SELECT query_id, record_id, round(sum(1e0 / (60 + rank)), 12) AS score, CAST(min(source) AS BIGINT) AS source FROM u GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank, record_id, round(score, 9) AS score, source FROM f""",
    "retrieve_fused": f"""WITH {Q.CORPUS}, queries AS (SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS vec FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
      {Q.document_tokens(VALID)}, {Q.fp_ctes('queries')}, {Q.bm25_ctes('queries', k=10)},
      sims AS (SELECT query_id, record_id, round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) AS score
        FROM queries, embeddings JOIN corpus ON vec_id = doc_id WHERE vec IS NOT NULL AND status = 'validated'),
      dense AS (SELECT * FROM (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM sims WHERE score >= 0.2) WHERE rank <= 10),
      u AS (SELECT query_id, record_id, rank, 0 AS source FROM top JOIN queries USING (query_id) WHERE vec IS NOT NULL UNION ALL SELECT query_id, record_id, rank, 1 FROM dense),
      f AS (SELECT query_id, record_id, round(sum(1e0 / (60 + rank)), 12) AS score, min(source) AS source FROM u GROUP BY ALL),
      fused AS (SELECT query_id, record_id, score, CASE WHEN source = 0 THEN 'lexical' ELSE 'dense' END AS matched,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM f
        UNION ALL SELECT query_id, record_id, score, 'lexical', rank FROM top JOIN queries USING (query_id) WHERE vec IS NULL), {_tiers('fused')}
      SELECT query_id, rank, record_id, round(score, 9) AS score, matched FROM hitlist""",
    "build_idf": f"WITH {IDF} SELECT word, df FROM idf",
    "globally_common": f"""WITH {IDF}, t AS (SELECT conv_id, turn, unnest(list_distinct({Q.query_tokens('lower(text)')})) AS token FROM conversations)
      SELECT conv_id, turn, token, coalesce(df / n > 0.1, false) AS common FROM t LEFT JOIN idf ON word = token, tot""",
    "ecosystem_names": f"WITH {Q.CORPUS}, {ECO} SELECT word FROM eco",
    "doc_freq": f"""WITH {Q.CORPUS}, {Q.TURN_QUERIES}, {Q.document_tokens()}, {Q.phrase_ctes('queries')}
      SELECT phrase, count(*) FILTER ({VALID}) AS df_validated, count(*) FILTER ({ELIGIBLE}) AS df_eligible
      FROM hits JOIN corpus USING (record_id) GROUP BY phrase HAVING count(*) FILTER ({VALID}) > 0""",
    "discriminative_tokens": f"""WITH {Q.CORPUS}, {Q.TURN_QUERIES}, {IDF}, {ECO}, {Q.document_tokens(ELIGIBLE)}, {DISC}
      SELECT query_id, token, pos, phrase, df, common FROM disc""",
    "corroborate": f"""WITH {Q.CORPUS}, {Q.TURN_QUERIES}, {IDF}, {Q.document_tokens(VALID)}, {gate_ctes()}, {gate_scan('SELECT word FROM stopl')},
      {Q.bm25_ctes('queries')}, {Q.hits_ctes('gphr', 'g')},
      backed AS (SELECT query_id, record_id FROM top JOIN gphr USING (query_id) JOIN ghits USING (phrase, record_id) GROUP BY ALL HAVING count(DISTINCT token) >= 2)
      SELECT query_id, rank, record_id, round(score, 6) AS score FROM top JOIN backed USING (query_id, record_id)""",
    "push_gate": f"""WITH {Q.CORPUS}, {Q.TURN_QUERIES}, {IDF}, {ECO}, {Q.document_tokens(ELIGIBLE)}, {Q.fp_ctes('queries')}, {DISC},
      summ AS (SELECT query_id, coalesce(list(token ORDER BY pos) FILTER (NOT common), []) AS tokens, count(*) FILTER (common) AS idf_filtered FROM disc
        WHERE query_id NOT IN (SELECT query_id FROM exact) GROUP BY query_id),
      opened AS (SELECT query_id, array_to_string(tokens, ' ') AS text, error_trigger FROM summ JOIN queries USING (query_id)
        WHERE len(tokens) >= 2 OR (error_trigger AND len(tokens) >= 1)),
      {Q.bm25_ctes('opened', 'o', floor=3.0)},
      backed AS (SELECT query_id, record_id FROM otop JOIN disc USING (query_id) JOIN ghits USING (phrase, record_id) WHERE NOT common GROUP BY ALL HAVING count(DISTINCT token) >= 2),
      fin AS (SELECT query_id, rank, record_id FROM otop JOIN opened USING (query_id) WHERE error_trigger
        UNION ALL SELECT query_id, rank, record_id FROM otop JOIN opened USING (query_id) JOIN backed USING (query_id, record_id) WHERE NOT error_trigger
        UNION ALL SELECT query_id, rank, record_id FROM exact),
      lst AS (SELECT query_id, string_agg(record_id, ',' ORDER BY rank) AS served, count(*) AS cnt FROM fin GROUP BY query_id)
      SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM exact) THEN 'fingerprint' WHEN coalesce(len(tokens), 0) = 0 THEN 'closed'
          WHEN NOT error_trigger AND len(tokens) < 2 THEN 'single' ELSE 'retrieved' END AS path,
        coalesce(array_to_string(tokens, ' '), '') AS tokens, coalesce(idf_filtered, 0) AS idf_filtered, coalesce(served, '') AS served, coalesce(cnt, 0) AS count
      FROM queries LEFT JOIN summ USING (query_id) LEFT JOIN lst USING (query_id)""",
    "embedding_cache_miss": f"""WITH {Q.CORPUS}, t AS (SELECT status, {Q.utrim("concat_ws(chr(10), title, nullif(summary, ''), CASE WHEN len(signatures) > 0 THEN array_to_string(signatures, chr(10)) END, nullif(summary, ''), nullif(array_to_string(signatures, chr(10)), ''))")} AS text FROM corpus),
      h AS (SELECT status, text, sha256(text) AS hash FROM t WHERE text <> '')
      SELECT hash, min(length(text)) AS chars FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE status = 'validated') GROUP BY hash""",
}
