"""SQL building blocks of the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import UNICODE_SPACES

SPACE_CLASS = (
    r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def utrim(e: str) -> str:
    return f"trim({e}, {q(UNICODE_SPACES)})"


def norm(e: str) -> str:
    """Signature normalisation, RE2 spelling."""
    s = f"lower({utrim(e)})"
    for pattern, repl in (
        (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"0x[0-9a-f]+", "<addr>"),
        (r"\b[0-9a-f]{8,}\b", "<hex>"),
        (r"(^|\s)(?:~|\.{1,2})?/\S+", r"\1<path>"),
        (r"\b[0-9]+\b", "<num>"),
        (r"\s+", " "),
    ):
        s = f"regexp_replace({s}, {q(pattern)}, {q(repl)}, 'g')"
    return utrim(s)


def fingerprint(e: str) -> str:
    return f"('sha256:' || sha256('generic' || chr(10) || {norm(e)}))"


def terms(e: str) -> str:
    return f"list_filter(string_split_regex(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def words(e: str) -> str:
    return f"list_filter(string_split_regex(lower({e}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"


def fields(e: str) -> str:
    return f"list_filter(string_split_regex({e}, {q(SPACE_CLASS + '+')}), lambda x: x <> '')"


def query_tokens(e: str) -> str:
    stripped = f"list_transform({fields(e)}, lambda x: regexp_replace(x, '\\p{{Cc}}', '', 'g'))"
    return f"list_filter({stripped}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nd}}]'))"


def rid(e: str) -> str:
    return f"printf('exp-%04d', {e})"


STATUS = """CASE WHEN quality IS NULL THEN 'quarantined' WHEN quality = 1 AND toxic = 0 THEN 'validated'
  WHEN quality = 1 THEN 'disputed' WHEN toxic = 0 THEN 'stale' ELSE 'superseded' END"""

CORPUS = f"""corpus AS (
  SELECT d.doc_id, {rid('d.doc_id')} AS id, {rid('d.doc_id')} AS record_id,
    CASE lang WHEN 'en' THEN 'trap' WHEN 'de' THEN 'fix' WHEN 'fr' THEN 'dead-end' WHEN 'es' THEN 'convention' END AS kind,
    {STATUS} AS status,
    string_split(text, chr(10))[1] AS title,
    coalesce(string_split(text, chr(10))[2], '') AS summary,
    string_split(text, chr(10))[3:] AS signatures,
    text AS body, lang, source,
    CASE WHEN lang = 'es' THEN 'alpha:' || source ELSE source END AS author,
    CASE WHEN contains(text, 'Apache License') THEN 'Apache-2.0' WHEN contains(text, 'MIT License') THEN 'MIT'
      WHEN contains(text, 'GNU General Public License') THEN 'GPL-3.0' WHEN contains(text, 'CC BY-NC') THEN 'CC-BY-NC-4.0'
      WHEN lang = 'es' THEN 'none (facts only)' WHEN lang = 'de' THEN 'none (authored, internal-only)' ELSE '' END AS source_license,
    CASE WHEN contains(text, 'http') OR contains(text, 'Apache License') THEN 'https://example.org/' || source ELSE '' END AS source_url,
    'experience/2024/' || substr({rid('d.doc_id')}, 5) || '-' || source || '.md' AS path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

BENCHMARK_QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
TURN_QUERIES = """queries AS (SELECT conv_id || '/' || turn AS query_id, text, role = 'system' AS error_trigger
  FROM conversations)"""


def document_tokens(flag: str = "true") -> str:
    """toks(record_id, toks, dl, allowed) over documents; ``flag`` is an expression over corpus."""
    return f"""toks AS (SELECT record_id, {terms('body')} AS toks, len({terms('body')}) AS dl, ({flag}) AS allowed FROM corpus)"""


def phrase_ctes(queries: str, prefix: str = "", cap: int | None = None) -> str:
    """<p>qphr(query_id, phrase, qtf) and <p>hits(phrase, record_id, tf) against ``toks``."""
    sl = f"[1:{cap}]" if cap else ""
    return f"""{prefix}qphr AS (SELECT query_id, phrase, count(*) AS qtf FROM (
      SELECT query_id, array_to_string({terms('tok')}, ' ') AS phrase
      FROM (SELECT query_id, unnest(({query_tokens('text')}){sl}) AS tok FROM {queries})) WHERE phrase <> '' GROUP BY ALL),
  {hits_ctes(prefix + 'qphr', prefix)}"""


def hits_ctes(source: str, prefix: str = "") -> str:
    return f"""{prefix}voc AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w FROM {source}),
  {prefix}post AS (SELECT record_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM toks),
  {prefix}hits AS (
    SELECT phrase, record_id, count(*) AS tf FROM {prefix}post JOIN {prefix}voc ON term = w[1] WHERE len(w) = 1 GROUP BY ALL
    UNION ALL
    SELECT phrase, p.record_id, count(*) AS tf FROM {prefix}post p JOIN {prefix}voc ON term = w[1] AND len(w) > 1
      JOIN toks t ON t.record_id = p.record_id WHERE t.toks[pos:pos + len(w) - 1] = w GROUP BY ALL)"""


def bm25_ctes(queries: str, prefix: str = "", k: int = 3, floor: float = 2e-6) -> str:
    """<p>top(query_id, rank, record_id, score)."""
    p = prefix
    where = f"WHERE score >= {floor!r}" if floor > 0 else ""
    return f"""{phrase_ctes(queries, p)},
  {p}stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM toks),
  {p}dfs AS (SELECT phrase, count(*) AS df FROM {p}hits GROUP BY ALL),
  {p}wts AS (SELECT query_id, phrase, avgdl,
      qtf * CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) > 0 THEN ln((n - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END AS weight
      FROM {p}qphr JOIN {p}dfs USING (phrase), {p}stats),
  {p}scored AS (SELECT query_id, record_id, round(sum(weight * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) AS score
      FROM {p}hits JOIN {p}wts USING (phrase) JOIN toks USING (record_id) WHERE allowed GROUP BY ALL),
  {p}top AS (SELECT query_id, rank, record_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM {p}scored {where}) WHERE rank <= {k})"""


def fp_ctes(queries: str, prefix: str = "", allowed: str = "status = 'validated'", k: int = 3) -> str:
    """<p>exact(query_id, rank, record_id): whole-text fingerprints over corpus."""
    p = prefix
    return f"""{p}fps AS (SELECT DISTINCT {fingerprint('body')} AS fp, record_id FROM corpus WHERE {allowed}),
  {p}exact AS (SELECT query_id, rank, record_id FROM (
      SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY record_id) AS rank
      FROM (SELECT DISTINCT query_id, record_id FROM (SELECT query_id, {fingerprint('text')} AS fp FROM {queries} WHERE {utrim('text')} <> '') JOIN {p}fps USING (fp)))
      WHERE rank <= {k})"""
