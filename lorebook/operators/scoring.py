"""The k best records of many queries, by blocks of queries that read the records in turn.

Records and queries are lists of phrases as numbers, put together where their texts lie.  A task holds a block of
queries and reads the stored records block by block: it multiplies weights with frequent phrases as matrices,
adds the postings of the others, and keeps each query's k best; a block's records below a query's k-th best so far
are not looked at again.  Nothing is left out, no (query, record) pair is shuffled, and nothing is copied for each
pair of blocks, so what lies on disk grows with the tables and not with their product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import count as counting

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage

# Bounds of a block: its entries (postings or weights) and its rows.
MOST_ENTRIES, MOST_ROWS = 1 << 21, 1 << 15
# Cells (query, record) and postings that a task holds at once, and cells of its matrix of frequent phrases.
MOST_CELLS, MOST_POSTINGS, MOST_DENSE = 1 << 21, 1 << 22, 1 << 23
# A phrase is a row of that matrix if at least this share of a block's pairs (query, record) have it on both sides:
# a matrix takes so much less time for a pair than a posting does.
FREQUENT = 3e-3
# Closer scores are told apart only after rounding.
MARGIN = 2e-9
# Bits of a phrase's number, and of the filter of phrases of several words; terms counted at once.
BITS, FILTER_BITS, MOST_TERMS = 64, 26, 1 << 21
# It stands between the words of a phrase, or at its ends, where the phrases of a text are told by one pass over it.
SEAM = b"\x01"


def gathered(hits: DataFrame) -> DataFrame:
    """(record_id, dl, codes, tfs): the entries of each record of ``hits`` (record_id, code, tf, dl); stored.

    Hits that lie by their record are put together where they lie, so give them as they are counted: read
    back from files, a task gets as many of them as the files are dense."""
    entries = hits.groupBy("record_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("code", "tf")).alias("e"))
    return cut_lineage(entries.select("record_id", "dl", F.col("e.code").alias("codes"), F.col("e.tf").alias("tfs")))


def entries(records: DataFrame) -> DataFrame:
    """(record_id, dl, code, tf): the hits that :func:`gathered` has put together."""
    return records.select("record_id", "dl", F.explode(F.arrays_zip("codes", "tfs")).alias("e")).select("record_id", "dl", F.col("e.codes").alias("code"), F.col("e.tfs").alias("tf"))


def best_of_blocks(
    hits: DataFrame, weights: DataFrame, part: Callable[[np.ndarray, np.ndarray, float], np.ndarray], k: int, floor: float, digits: int
) -> DataFrame:
    """(query_id, record_id, score): at most k records of each query per block, all of its k best among them.

    ``hits`` is (record_id, code, tf, dl), ``weights`` is (query_id, code, weight, avgdl) with each code once a
    query; a record's score is the sum of weight * part(tf, dl, avgdl).  Ties after rounding to ``digits`` go
    to the lower record_id.
    """
    return best_of_records(gathered(hits), weights, part, k, floor, digits)


def best_of_records(
    records: DataFrame, weights: DataFrame, part: Callable[[np.ndarray, np.ndarray, float], np.ndarray], k: int, floor: float, digits: int
) -> DataFrame:
    """:func:`best_of_blocks` of records that are put together and stored."""
    queries = cut_lineage(
        weights.groupBy("query_id").agg(F.max("avgdl").alias("avgdl"), F.collect_list(F.struct("code", "weight")).alias("e"))
        .select("query_id", "avgdl", F.col("e.code").alias("codes"), F.col("e.weight").alias("weights"))
    )
    return best_of_stored(records, queries, part, k, floor, digits)


def best_of_stored(
    records: DataFrame,
    queries: DataFrame,
    part: Callable[[np.ndarray, np.ndarray, float], np.ndarray],
    k: int,
    floor: float,
    digits: int,
    df: DataFrame | None = None,
    idf: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """:func:`best_of_blocks` of stored ``records`` (record_id, dl, codes, tfs) and stored ``queries`` (query_id,
    avgdl, codes, weights).  With a stored ``df`` (code, df), weights are multiplied by ``idf`` of it.

    A query is shuffled once, to its block; tasks read the files of ``records`` and ``df`` where they lie."""
    spark = records.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wide = -(-_blocks(queries) // cores) * cores
    # A block's key is one that Spark deals to a partition of its own.
    part_of = F.pmod(F.hash(F.col("id").cast("int")), F.lit(wide))
    keys = [r["key"] for r in spark.range(wide * 16 + 256).groupBy(part_of.alias("p")).agg(F.min("id").cast("int").alias("key")).orderBy("p").collect()]
    wide = len(keys)
    key = F.get(F.lit(keys).cast("array<int>"), F.pmod(F.xxhash64("query_id"), F.lit(wide)).cast("int"))
    dealt = queries.select(key.alias("block"), "*").repartition(wide, "block")
    # What each block reads.
    reads = spark.createDataFrame([(key, records.inputFiles(), df.inputFiles() if df is not None else []) for key in keys], "block int, records array<string>, df array<string>")
    kind = queries.schema["query_id"].dataType.simpleString()
    ids = records.schema["record_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(reads.repartition(wide, "block").groupBy("block")).applyInArrow(
        _met(part, k, floor, digits, idf, to_arrow_type(records.schema["record_id"].dataType)), f"query_id {kind}, record_id {ids}, score double"
    )


def _blocks(rows: DataFrame) -> int:
    n, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    return max(1, -(-entries // (2 * MOST_ENTRIES)), -(-n // MOST_ROWS))


def numbered(phrases: DataFrame) -> DataFrame:
    """``phrases`` with a number of its own (``code``) for each row; stored, so that it can't change."""
    return cut_lineage(phrases.withColumn("code", F.monotonically_increasing_id()))


def stored_batches(files: Sequence[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of stored files; a task reads them where they lie."""
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


def _record_blocks(files: Sequence[str]) -> Iterator[pa.Table]:
    """The stored records, as many at once as a block may hold."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in stored_batches(files, ["record_id", "dl", "codes", "tfs"], min(1024, MOST_ROWS)):
        # Rows without a length tell about codes.
        batch = batch.filter(batch.column("dl").is_valid())
        n = len(batch.column("codes").flatten())
        if held and (rows + len(batch) > MOST_ROWS or entries + n > MOST_ENTRIES):
            yield pa.Table.from_batches(held)
            held, rows, entries = [], 0, 0
        held.append(batch)
        rows, entries = rows + len(batch), entries + n
    if held:
        yield pa.Table.from_batches(held)


def _met(part: Callable, k: int, floor: float, digits: int, idf: Callable | None, ids: pa.DataType) -> Callable:
    def met(key: tuple, queries: pa.Table, reads: pa.Table) -> pa.Table:
        who, names, scores = [np.zeros(0, np.int64)], [pa.array([], ids)], [np.zeros(0)]
        queries = queries.combine_chunks()
        limit = np.zeros(0)
        if len(queries) and len(reads):
            asked = _Asked(queries, k, floor)
            limit = asked.limit
            if idf is not None:
                asked.weigh(reads.column("df")[0].as_py(), idf)
            for records in _record_blocks(reads.column("records")[0].as_py()):
                # In the order of ids, so that the lower of two places is the lower id.
                records = records.sort_by("record_id").combine_chunks()
                for q, r, s in _best(records, asked, part, k, digits):
                    who.append(q)
                    names += records.column("record_id").take(pa.array(r)).cast(ids).chunks
                    scores.append(s)
        q, s = np.concatenate(who), np.concatenate(scores)
        keep = s >= limit[q]
        return pa.table(
            {
                "query_id": queries.column("query_id").take(pa.array(q[keep])),
                "record_id": pa.chunked_array(names, ids).filter(pa.array(keep)),
                "score": pa.array(s[keep]),
            }
        )

    return met


def _entries(table: pa.Table, codes: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, value) of the entries of a table with two columns of lists."""
    lists = [table.column(c).combine_chunks() for c in (codes, values)]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()


class _Asked:
    """A block of queries: its different codes, its entries (owner, place of the code, weight), and for each query
    its k best scores so far and the limit that they set."""

    def __init__(self, queries: pa.Table, k: int, floor: float) -> None:
        self.n = len(queries)
        self.owner, code, weight = _entries(queries, "codes", "weights")
        self.codes, at = np.unique(code, return_inverse=True)
        self.at, self.weight = at.astype(np.int32), weight.astype(np.float64)
        self.avgdl = queries.column("avgdl")[0].as_py()
        self.best = np.full((self.n, k), -np.inf)
        # Scores are above zero.
        self.limit = np.full(self.n, max(floor - MARGIN, np.finfo(float).tiny))

    def weigh(self, files: Sequence[str], idf: Callable) -> None:
        """Multiply the weights by the idf of their code; one that no record holds weighs nothing."""
        factor = np.zeros(len(self.codes))
        for batch in stored_batches(files, ["code", "df"], 1 << 18):
            code, df = (batch.column(c).to_numpy() for c in ("code", "df"))
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[place] == code if len(self.codes) else np.zeros(len(code), bool)
            factor[place[found]] = idf(df[found])
        self.weight = self.weight * factor[self.at]

    def found(self, q: np.ndarray, s: np.ndarray, k: int) -> None:
        """Take in scores, at most k of each of some queries, which come together."""
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        mine = q[first]
        both = np.full((len(mine), 2 * k), -np.inf)
        both[:, :k] = self.best[mine]
        size = np.diff(np.r_[first, len(q)])
        both[np.repeat(np.arange(len(mine)), size), k + np.arange(len(q)) - np.repeat(first, size)] = s
        self.best[mine] = np.partition(both, k, axis=1)[:, k:]
        self.limit[mine] = np.maximum(self.limit[mine], self.best[mine].min(axis=1) - MARGIN)


def _best(records: pa.Table, asked: _Asked, part: Callable, k: int, digits: int) -> Iterator[tuple]:
    """(places of queries, places of records, scores) by runs of queries: what reaches the limit of its query, at most k."""
    n = len(records)
    at, code, tf = _entries(records, "codes", "tfs")
    if not len(code) or not len(asked.codes):
        return
    lengths = records.column("dl").to_numpy().astype(np.float64)
    value = part(tf.astype(np.float64), lengths[at], asked.avgdl)
    order = np.argsort(code, kind="stable")
    code, at, value = code[order], at[order].astype(np.int32), value[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    count, known = np.diff(np.r_[start, len(code)]), code[start]

    # Only codes of both sides.
    place = np.minimum(np.searchsorted(known, asked.codes), len(known) - 1)
    place[known[place] != asked.codes] = -1
    row = place[asked.at]
    found = np.flatnonzero((row >= 0) & (asked.weight > 0))
    owner, row, weight = asked.owner[found], row[found], asked.weight[found]

    wanted = count * np.bincount(row, minlength=len(known))
    frequent = np.argsort(-wanted, kind="stable")[: max(1, MOST_DENSE // n)]
    frequent = frequent[wanted[frequent] >= max(2, FREQUENT * n * asked.n)]
    place = np.full(len(known), -1, np.int32)
    place[frequent] = np.arange(len(frequent))
    matrix = np.zeros((len(frequent), n))
    for f, t in enumerate(frequent.tolist()):
        span = slice(start[t], start[t] + count[t])
        matrix[f, at[span]] = value[span]

    dense = place[row] >= 0
    gathered = np.bincount(owner[~dense], count[row[~dense]], asked.n)
    for a, z in _runs(gathered, max(1, MOST_CELLS // n)):
        lo, hi = np.searchsorted(owner, [a, z])
        o, r, w, d = owner[lo:hi] - a, row[lo:hi], weight[lo:hi], dense[lo:hi]
        factor = np.zeros((z - a, len(frequent)))
        factor[o[d], place[r[d]]] = w[d]
        scores = factor @ matrix
        o, r, w = o[~d], r[~d], w[~d]
        c = count[r]
        every = np.repeat(start[r] - (np.cumsum(c) - c), c)
        every += np.arange(len(every))
        cell = np.repeat(o * n, c)
        cell += at[every]
        worth = value[every]
        worth *= np.repeat(w, c)
        scores += np.bincount(cell, worth, (z - a) * n).reshape(z - a, n)
        least = asked.limit[a:z, None]
        good = scores >= least
        if n > k and np.count_nonzero(good) > 8 * k * (z - a):
            least = np.maximum(least[:, 0], np.partition(scores, n - k, axis=1)[:, n - k] - MARGIN)[:, None]
            good = scores >= least
        cells = np.flatnonzero(good)
        q, i = np.divmod(cells, n)
        s = scores.ravel()[cells]
        o = np.lexsort((i, -np.round(s, digits), q))
        q, i, s = q[o], i[o], s[o]
        first = np.searchsorted(q, np.arange(z - a))
        keep = np.arange(len(q)) - first[q] < k
        q, i, s = q[keep] + a, i[keep], s[keep]
        asked.found(q, s, k)
        yield q, i, s


def _runs(gathered: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, z) of at most ``most`` queries, and of as many postings as a task may hold (or one query)."""
    a, held = 0, 0.0
    for i, g in enumerate(gathered.tolist()):
        if i > a and (i - a >= most or held + g > MOST_POSTINGS):
            yield a, i
            a, held = i, 0.0
        held += g
    yield a, len(gathered)


# ---------------------------------------------------------------- numbers of phrases


def _hashed(words: Sequence[bytes], salt: int) -> np.ndarray:
    """Two numbers for each word: the one that stands for it, and one to find words that share the first."""
    key = salt.to_bytes(8, "little")
    return np.array([hashlib.blake2b(w, digest_size=16, key=key).digest() for w in words], "V16").view(np.uint64).reshape(-1, 2)


def _joined(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Both numbers of phrases, from those of the phrase without its last word and of that word."""
    with np.errstate(over="ignore"):
        x = head * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + word
        x ^= x >> np.uint64(32)
        x *= np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
        return x ^ (x >> np.uint64(29))


def _number(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _counted(row: np.ndarray, which: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, which, count) of the different pairs, in order."""
    key, n = np.unique(row * kinds + which, return_counts=True)
    return key // kinds, key % kinds, n


def _lists(rows: np.ndarray, row: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """The values of each of ``rows``; ``row`` is in order."""
    offsets = pa.array(np.searchsorted(row, np.r_[rows, rows[-1] + 1 if len(rows) else 0]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most MOST_TERMS values together (or one row)."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_TERMS, "right")))
        yield a, z
        a = z


def query_entries(phrases: DataFrame, salt: int, bits: int = BITS) -> DataFrame:
    """(query_id, codes, qtfs, checks, heads) from (query_id, phrases): the different phrases of each query, their words
    between single blanks or SEAMs.  Rows with ``checks`` tell the second numbers of codes; their ``heads`` are numbers of the openings of longer phrases.  Stored."""
    kind = phrases.schema["query_id"].dataType.simpleString()
    merged = phrases.groupBy("query_id").agg(F.flatten(F.collect_list("phrases")).alias("phrases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("phrases")
            for a, z in _slices(np.diff(lists.offsets.to_numpy())):
                part = lists.slice(a, z - a)
                sizes = np.diff(part.offsets.to_numpy())
                words = part.flatten().dictionary_encode()
                known: dict[bytes, int] = {}
                kinds = [known.setdefault(w.strip(SEAM).replace(SEAM, b" "), len(known)) for w in words.dictionary.cast(pa.binary()).to_pylist()]
                names = list(known)
                first = _hashed([n.split(b" ", 1)[0] for n in names], salt)
                heads = []
                for i, name in enumerate(names):
                    if b" " in name:
                        x = first[i : i + 1]
                        for w in _hashed(name.split(b" ")[1:], salt):
                            x = _joined(x, w[None])
                            heads.append(x[0, 0])
                        first[i] = x[0]
                row, which, n = _counted(np.repeat(np.arange(z - a), sizes), np.array(kinds, np.int64)[words.indices.to_numpy()], max(1, len(names)))
                keep = np.array([n != b"" for n in names], bool)[which]
                row, which, n = row[keep], which[keep], n[keep]
                rows = np.unique(row)
                codes, counts = _lists(rows, row, _number(first[:, 0], bits)[which], n)
                none = pa.nulls(len(rows), pa.list_(pa.int64()))
                yield _batch(batch.column("query_id").slice(a, z - a).take(pa.array(rows)), codes, counts, none, none)
                ok = np.unique(which)
                mine = first[ok]
                yield _batch(
                    pa.nulls(1, batch.column("query_id").type), _one(_number(mine[:, 0], bits)), _one(np.zeros(len(mine), np.int64)), _one(mine[:, 1].view(np.int64)),
                    _one(np.unique(_number(np.array(heads, np.uint64), bits))),
                )

    def _batch(ids: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([ids, *columns], names=["query_id", "codes", "qtfs", "checks", "heads"])

    return cut_lineage(merged.mapInArrow(run, f"query_id {kind}, codes array<bigint>, qtfs array<bigint>, checks array<bigint>, heads array<bigint>"))


def _one(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def record_entries(tokens: DataFrame, heads: DataFrame, salt: int, keep: Column | None = None, bits: int = BITS) -> DataFrame:
    """(record_id, dl, codes, tfs, checks, rows, terms) from (record_id, fields, dl): the different terms of each record,
    and its runs of terms that may be phrases of the stored ``heads``.  Rows with ``checks`` tell about some of all
    records: in how many a code is (``tfs``), its second number, and how many rows and terms there are; the other rows
    are only of records that ``keep``.  A run that rows of one id hold at the same place is not counted.  Stored.

    Records are taken where they lie by their id: no term is shuffled."""
    kind = tokens.schema["record_id"].dataType.simpleString()
    files = heads.inputFiles()
    kept = F.lit(True) if keep is None else F.coalesce(F.bool_or(keep), F.lit(False))
    merged = tokens.groupBy("record_id").agg(
        F.max("dl").alias("dl"), kept.alias("kept"), F.count("*").alias("rows"), F.sum("dl").alias("terms"), F.flatten(F.collect_list("fields")).alias("fields")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        several = False
        for batch in stored_batches(files, ["head"], 1 << 18):
            slot = _slot(batch.column("head").to_numpy())
            np.bitwise_or.at(filter_, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
            several = several or len(slot) > 0
        for batch in batches:
            fields = batch.column("fields")
            per_record = np.diff(fields.offsets.to_numpy())
            per_field = np.diff(fields.flatten().offsets.to_numpy())
            rows_of = batch.column("rows").to_numpy()
            repeated, per_row = rows_of > 1, np.maximum(1, per_record // rows_of)
            ends = np.r_[0, np.cumsum(per_field)][np.r_[0, np.cumsum(per_record)]]
            for a, z in _slices(np.diff(ends)):
                columns = fields.slice(a, z - a).flatten()
                sizes = np.diff(columns.offsets.to_numpy())
                terms = columns.flatten().dictionary_encode()
                hashed, index = _hashed(terms.dictionary.cast(pa.binary()).to_pylist(), salt), terms.indices.to_numpy().astype(np.int64)
                column = np.repeat(np.arange(len(sizes)), sizes)
                record = np.repeat(np.arange(z - a), per_record[a:z])[column]
                row, which, n = _counted(record, index, max(1, len(hashed)))
                numbers, checks = [_number(hashed[:, 0], bits)], [hashed[:, 1]]
                if several:
                    again = repeated[a:z]
                    # Of each field: its number in its row, and where it starts.
                    of_row = (np.arange(len(sizes)) - np.repeat(np.cumsum(per_record[a:z]) - per_record[a:z], per_record[a:z])) % np.repeat(per_row[a:z], per_record[a:z])
                    starts = np.cumsum(sizes) - sizes
                    parts = [(row, which, n)]
                    at = np.arange(len(index) - 1)
                    x = hashed[index[:-1]] if len(index) else hashed[:0]
                    length = 1
                    while len(at):
                        # One more word, inside the same column.
                        go = (at + length < len(index)) & (column[np.minimum(at + length, len(index) - 1)] == column[at])
                        at, x = at[go], x[go]
                        x = _joined(x, hashed[index[at + length]])
                        slot = _slot(_number(x[:, 0], bits))
                        go = (filter_[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                        at, x = at[go], x[go]
                        length += 1
                        if len(at):
                            kinds, first, inverse = np.unique(x[:, 0], return_index=True, return_inverse=True)
                            done = sum(map(len, numbers))
                            use = np.ones(len(at), bool)
                            if len(twice := np.flatnonzero(again[record[at]])):
                                field = column[at[twice]]
                                place = np.stack([record[at[twice]], of_row[field], at[twice] - starts[field], inverse[twice]])
                                _, which_, c = np.unique(place, axis=1, return_inverse=True, return_counts=True)
                                use[twice[c[which_] > 1]] = False
                            r, w, c = _counted(record[at[use]], inverse[use], len(kinds))
                            parts.append((r, w + done, c))
                            numbers.append(_number(kinds, bits))
                            checks.append(x[first, 1])
                    row, which, n = (np.concatenate(v) for v in zip(*parts, strict=True))
                    order = np.argsort(row, kind="stable")
                    row, which, n = row[order], which[order], n[order]
                number, check = np.concatenate(numbers), np.concatenate(checks)
                yes = batch.column("kept").slice(a, z - a).to_numpy(zero_copy_only=False)
                rows = np.unique(row)
                rows = rows[yes[rows]]
                mine = yes[row]
                codes, tfs = _lists(rows, row[mine], number[which[mine]], n[mine])
                none = pa.nulls(len(rows), pa.list_(pa.int64()))
                take = pa.array(rows)
                yield _batch(batch.column("record_id").slice(a, z - a).take(take), batch.column("dl").slice(a, z - a).take(take), codes, tfs, none, *[pa.nulls(len(rows), pa.int64())] * 2)
                sums = [pa.array([batch.column(c).slice(a, z - a).to_numpy().sum()], pa.int64()) for c in ("rows", "terms")]
                yield _batch(
                    pa.nulls(1, batch.column("record_id").type), pa.nulls(1, pa.int64()), _one(number), _one(np.bincount(which, minlength=len(number))), _one(check.view(np.int64)), *sums
                )

    def _batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch(list(columns), names=["record_id", "dl", "codes", "tfs", "checks", "rows", "terms"])

    return cut_lineage(merged.mapInArrow(run, f"record_id {kind}, dl bigint, codes array<bigint>, tfs array<bigint>, checks array<bigint>, rows bigint, terms bigint"))


def _slot(number: np.ndarray) -> np.ndarray:
    return (number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def matched(phrases: DataFrame, tokens: DataFrame, keep: Column | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame, int, float]:
    """Stored queries (query_id, codes, qtfs), records (record_id, dl, codes, tfs) and (code, df) of
    (query_id, phrases) and (record_id, fields, dl), the number of rows and their average length.  Records are those
    that ``keep``; all else is of every record.

    A number is a hash of its phrase; if two phrases share one, all are numbered anew."""
    told = F.col("checks").isNotNull()
    for salt in counting():
        queries = query_entries(phrases, salt, bits)
        records = record_entries(tokens, cut_lineage(queries.where(told).select(F.explode("heads").alias("head")).distinct()), salt, keep, bits)
        cells = [
            table.where(told).select(F.explode(F.arrays_zip("codes", n, "checks")).alias("e"), F.lit(asked).alias("asked"))
            .select(F.col("e.codes").alias("code"), F.col(f"e.{n}").alias("df"), F.col("e.checks").alias("check"), "asked")
            for table, n, asked in ((records, "tfs", False), (queries, "qtfs", True))
        ]
        counted = cells[0].unionByName(cells[1]).groupBy("code").agg(
            F.sum("df").alias("df"), F.bool_or("asked").alias("asked"), (F.min("check") != F.max("check")).alias("shared")
        )
        df = cut_lineage(counted.where((F.col("asked") & (F.col("df") > 0)) | F.col("shared")))
        if df.where("shared").isEmpty():
            n, terms = records.where(told).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
            return queries.where(~told), records.where(~told), df, n, terms / max(1, n)
    raise AssertionError
