"""A stored inverted index: built once, read by search and gate.

Records are dealt into blocks of about as many tokens, so that a block fits a task.  A segment of the index is
two bucketed tables of immutable files and one row per (term, block) in both:

``terms``   bucketed by term: records with the term, greatest frequency, least record length.  It answers
            document frequencies, and bounds what a block can score for a query.
``blocks``  bucketed by block: the same with record numbers, frequencies and places, and one row per block
            with its record ids and lengths.  It answers everything else, inside tasks.

A look-up shuffles the query side only: phrases or queries go to the blocks that they have to visit, and a
block is read where it lies.  A ranked query visits the block that promises most first; the k-th best score
there rules out the blocks whose bound stays below it.  Segments are added and merged by size; a manifest
names those that count, and the newest segment that holds a record wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import range_offsets, sorted_places
from ..session import cut_lineage
from ..sources import manifest

# Bounds of the tokens of a block, and queries that meet a block at once.  A task takes some 100 bytes for each token.
LEAST_TOKENS, MOST_TOKENS = 1 << 16, 1 << 19
PASS = 8192
# Phrases in at most so many records lead a query to its first blocks.
RARE = 100
BM25_K1, BM25_B = 1.2, 0.75
MIN_IDF = 1e-6
DECIMALS = 9

BLOCKS = (
    "block bigint, term string, n bigint, max_tf bigint, min_dl bigint, at binary, tf binary, places binary, ids array<string>, lengths array<bigint>"
)
TERMS = "term string, block bigint, n bigint, max_tf bigint, min_dl bigint"


def _block_rows(key: tuple, group: pa.Table) -> pa.Table:
    """Postings of one block from its records (block, record_id, fields, dl)."""
    group = group.sort_by("record_id").combine_chunks()
    ids, lengths = group.column("record_id").to_pylist(), np.array(group.column("dl").to_pylist(), np.int64)
    fields = group.column("fields").combine_chunks()
    columns = fields.flatten()
    per_record, per_column = np.diff(fields.offsets.to_numpy()), np.diff(columns.offsets.to_numpy())
    record = np.repeat(np.arange(len(ids)), per_record)
    column = np.arange(len(per_column)) - np.repeat(np.cumsum(per_record) - per_record, per_record)
    terms = columns.flatten().dictionary_encode()
    code = terms.indices.to_numpy()
    inside = np.arange(len(code)) - np.repeat(np.cumsum(per_column) - per_column, per_column)
    place = np.repeat((record << 40) | (column << 32), per_column) + inside
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    who = place >> 40
    # One posting for each (term, record): places are in order inside a term.
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (who[1:] != who[:-1])]) if len(code) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[new, len(code)])
    at, p_code = who[new], code[new]
    starts = np.flatnonzero(np.r_[True, p_code[1:] != p_code[:-1]]) if len(new) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(new)].astype(np.int64)
    names = terms.dictionary.take(pa.array(p_code[starts])).to_pylist() if len(starts) else []
    at32, tf32 = at.astype(np.int32), tf.astype(np.int32)
    rows = {name: [] for name in ("n", "max_tf", "min_dl", "at", "tf", "places")}
    cuts = np.r_[new, len(code)]
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        rows["n"].append(z - a)
        rows["max_tf"].append(int(tf[a:z].max()))
        rows["min_dl"].append(int(lengths[at[a:z]].min()))
        rows["at"].append(at32[a:z].tobytes())
        rows["tf"].append(tf32[a:z].tobytes())
        rows["places"].append(place[cuts[a] : cuts[z]].tobytes())
    m = len(names) + 1
    block = key[0].as_py()
    return pa.table(
        {
            "block": pa.array([block] * m, pa.int64()),
            "term": pa.array([None, *names], pa.string()),
            "n": pa.array([len(ids), *rows["n"]], pa.int64()),
            "max_tf": pa.array([0, *rows["max_tf"]], pa.int64()),
            "min_dl": pa.array([0, *rows["min_dl"]], pa.int64()),
            **{name: pa.array([b"", *rows[name]], pa.binary()) for name in ("at", "tf", "places")},
            "ids": pa.array([ids, *[None] * (m - 1)], pa.list_(pa.string())),
            "lengths": pa.array([lengths.tolist(), *[None] * (m - 1)], pa.list_(pa.int64())),
        }
    )


class _Block:
    """One block's postings inside a task."""

    def __init__(self, rows: pa.Table, average: float) -> None:
        terms = rows.column("term").to_pylist()
        head = terms.index(None)
        self.ids = pa.array(rows.column("ids")[head].as_py(), pa.string())
        self.lengths = np.array(rows.column("lengths")[head].as_py(), np.float64)
        self.row = {t: i for i, t in enumerate(terms)}
        counts = np.array(rows.column("n").to_pylist(), np.int64)
        counts[head] = 0
        self.count, self.start = counts, np.cumsum(counts) - counts
        self.at = np.frombuffer(b"".join(rows.column("at").to_pylist()), np.int32)
        self.tf = np.frombuffer(b"".join(rows.column("tf").to_pylist()), np.int32)
        self.places = rows.column("places")
        self.norm = BM25_K1 * (1 - BM25_B + BM25_B * self.lengths / average)
        self.part = self.tf * (BM25_K1 + 1) / (self.tf + self.norm[self.at])
        top, low = (np.array(rows.column(c).to_pylist(), np.float64) for c in ("max_tf", "min_dl"))
        self.most = top * (BM25_K1 + 1) / (top + BM25_K1 * (1 - BM25_B + BM25_B * low / average))
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def hits(self, phrase: str) -> tuple[np.ndarray, np.ndarray]:
        """(record numbers, frequencies) of a phrase: its words one after another in one column."""
        words = phrase.split(" ")
        if len(words) == 1:
            i = self.row.get(phrase)
            s = slice(0, 0) if i is None else slice(self.start[i], self.start[i] + self.count[i])
            return self.at[s], self.tf[s]
        if phrase not in self.known:
            rows = [self.row.get(w) for w in words]
            found = np.zeros(0, np.int64)
            if None not in rows:
                # From the word with the fewest records on; a start is kept if the others follow.
                order = sorted(range(len(words)), key=lambda j: self.count[rows[j]])
                for step, j in enumerate(order):
                    starts = np.frombuffer(self.places[rows[j]].as_py(), np.int64) - j
                    found = starts if step == 0 else np.intersect1d(found, starts, assume_unique=True)
            self.known[phrase] = tuple(v.astype(np.int32) for v in np.unique(found >> 40, return_counts=True))
        return self.known[phrase]

    def scores(self, phrases: list[str], weights: np.ndarray, least: float) -> np.ndarray | None:
        """BM25 of all records of the block, or None if the block's bound for the query is below ``least``."""
        rows = np.array([self.row.get(p, -1) for p in phrases], np.int64)
        several = [(p, w) for p, w in zip(phrases, weights.tolist(), strict=True) if " " in p]
        keep = rows >= 0
        rows, weights = rows[keep], weights[keep]
        if (weights * self.most[rows]).sum() + sum(w * (BM25_K1 + 1) for _, w in several) < least:
            return None
        n = self.count[rows]
        every = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.bincount(self.at[every], self.part[every] * np.repeat(weights, n), len(self.ids)).astype(np.float64)
        for p, w in several:
            at, tf = self.hits(p)
            out[at] += w * tf * (BM25_K1 + 1) / (tf + self.norm[at])
        return np.round(out, DECIMALS)


def _mask(block: _Block, asked: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Which records count, from the row of ``asked`` that lists them (none: all), and the other rows."""
    kinds = asked.column("kind").to_numpy()
    mask = np.ones(len(block.ids), bool)
    for i in np.flatnonzero(kinds == 1).tolist():
        mask = np.isin(np.array(block.ids.to_pylist(), object).astype(str), np.array(asked.column("names")[i].as_py(), str))
    return mask, asked.filter(pa.array(kinds == 0))


@dataclass(frozen=True)
class StoredIndex:
    """An opened index: the folder, its buckets, and the names of the segments that count, oldest first."""

    spark: SparkSession
    root: str
    buckets: int
    tokens_per_block: int
    segments: tuple[str, ...]

    # ------------------------------------------------------------ writing

    @staticmethod
    def build(tokens: DataFrame, root: str) -> StoredIndex:
        """A new index below ``root`` of a token index (record_id, fields, dl) with one row per record."""
        spark = tokens.sparkSession
        tokens = cut_lineage(tokens.select("record_id", "fields", F.col("dl").cast("bigint")))
        cores = spark.sparkContext.defaultParallelism
        total = tokens.agg(F.sum("dl")).first()[0] or 0
        size = min(MOST_TOKENS, max(LEAST_TOKENS, total // (4 * cores)))
        # A join keeps to the buckets if the session's shuffles have no more partitions.
        buckets = min(4096, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * size)))
        return StoredIndex(spark, root, buckets, size, ())._added(tokens)

    @staticmethod
    def open(spark: SparkSession, root: str) -> StoredIndex | None:
        """The index below ``root`` as its newest manifest has it; None if there is none."""
        known = manifest.versions(spark, root)
        if not known:
            return None
        row = manifest.load(spark, root, known[-1])
        return StoredIndex(spark, root, row["buckets"], row["tokens_per_block"], tuple(row["segments"]))

    def add(self, tokens: DataFrame) -> StoredIndex:
        """The index with another segment; records that it already has are replaced."""
        return self._added(cut_lineage(tokens.select("record_id", "fields", F.col("dl").cast("bigint"))))

    def merge(self, factor: int = 4) -> StoredIndex:
        """Put the newest segments together as long as the one before them has less than ``factor`` times
        their tokens, so that there are only as many as the logarithm of the size."""
        sizes = {r.s: r.n for r in self._union("blocks", self.segments).where("term IS NULL").groupBy("s").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("n")).collect()}
        last, total = len(self.segments), 0
        while last and (total == 0 or sizes.get(self.segments[last - 1], 0) < factor * total):
            last -= 1
            total += sizes.get(self.segments[last], 0) or 1
        if len(self.segments) - last < 2:
            return self
        merged = cut_lineage(self._tokens(self.segments[last:]))
        return replace(self, segments=self.segments[:last])._added(merged)

    def _added(self, tokens: DataFrame) -> StoredIndex:
        name = f"seg-{uuid.uuid4().hex}"
        # Records that share the least hash of their terms stand together, so that near copies share blocks.
        least = F.array_min(F.transform(F.flatten("fields"), lambda t: F.xxhash64(t)))
        placed = sorted_places(tokens.select(F.struct(least.alias("least"), "record_id").alias("o"), (F.col("dl") + 1).alias("size")), "o")
        offsets = range_offsets(placed, {"before": F.sum("size")})
        upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("before")
        block = F.floor(first / self.tokens_per_block).cast("bigint")
        blocks = placed.join(F.broadcast(offsets), "_part").select(F.col("o.record_id").alias("record_id"), block.alias("block"))
        dealt = tokens.join(blocks, "record_id").repartition(self.buckets, "block")
        rows = dealt.groupBy("block").applyInArrow(_block_rows, BLOCKS)
        at = self._path(name, "blocks")
        rows.write.mode("overwrite").bucketBy(self.buckets, "block").sortBy("block").option("path", at).saveAsTable(self._name(name, "blocks"))
        terms = self._table(name, "blocks").where("term IS NOT NULL").select("term", "block", "n", "max_tf", "min_dl").repartition(self.buckets, "term")
        terms.write.mode("overwrite").bucketBy(self.buckets, "term").sortBy("term").option("path", self._path(name, "terms")).saveAsTable(self._name(name, "terms"))
        new = replace(self, segments=(*self.segments, name))
        # Readers keep the version that they opened.
        manifest.publish(self.spark, self.root, {"buckets": self.buckets, "tokens_per_block": self.tokens_per_block, "segments": new.segments})
        return new

    # ------------------------------------------------------------ tables

    def _path(self, segment: str, table: str) -> str:
        return f"{self.root}/{segment}/{table}"

    def _name(self, segment: str, table: str) -> str:
        return f"lorebook_{segment.replace('-', '_')}_{table}"

    def _table(self, segment: str, table: str) -> DataFrame:
        """The bucketed table of a segment, known to this session's catalog."""
        name = self._name(segment, table)
        if not self.spark.catalog.tableExists(name):
            schema, key = (BLOCKS, "block") if table == "blocks" else (TERMS, "term")
            self.spark.sql(
                f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self._path(segment, table)}'"
            )
        return self.spark.table(name)

    def _union(self, table: str, segments: tuple[str, ...]) -> DataFrame:
        parts = [self._table(s, table).withColumn("s", F.lit(s)) for s in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def records(self) -> DataFrame:
        """(record_id, s, block, dl): where each record's newest version is."""
        heads = self._union("blocks", self.segments).where("term IS NULL")
        order = F.array_position(F.array(*[F.lit(s) for s in self.segments]), F.col("s"))
        each = heads.select("s", "block", order.alias("o"), F.explode(F.arrays_zip("ids", "lengths")).alias("r"))
        each = each.select(F.col("r.ids").alias("record_id"), "s", "block", "o", F.col("r.lengths").alias("dl"))
        if len(self.segments) == 1:
            return each.drop("o")
        newest = each.groupBy("record_id").agg(F.max(F.struct("o", "s", "block", "dl")).alias("m"))
        return newest.select("record_id", "m.s", "m.block", "m.dl")

    def _tokens(self, segments: tuple[str, ...]) -> DataFrame:
        """(record_id, fields, dl) of the newest versions in some segments, put together from the postings."""
        part = replace(self, segments=segments)
        kept = part.records().groupBy("s", "block").agg(F.collect_list("record_id").alias("names"))
        rows = part._union("blocks", segments).join(kept, ["s", "block"])
        return rows.groupBy("s", "block").applyInArrow(_unfold, "record_id string, fields array<array<string>>, dl bigint")

    def totals(self) -> tuple[int, float]:
        r = self.records().agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
        return r.n, float(r.a or 0.0)

    def term_rows(self) -> DataFrame:
        return self._union("terms", self.segments)

    # ------------------------------------------------------------ look-ups

    def _visit(self, asked: DataFrame, served: DataFrame | None, make: Callable, schema: str, average: float) -> DataFrame:
        """``make(block, mask, asked rows)`` for every block that rows of ``asked`` (s, block, name, names, weights, least) visit.

        ``mask`` leaves the records that count: newest versions, and those in ``served``.
        """
        whole = len(self.segments) == 1 and served is None
        masks = None
        if not whole:
            live = self.records() if served is None else self.records().join(served.select("record_id").distinct(), "record_id", "left_semi")
            masks = live.groupBy("s", "block").agg(F.collect_list("record_id").alias("names"))
        def met(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
            if len(rows) and len(asked):
                block = _Block(rows.combine_chunks(), average)
                mask, rest = _mask(block, asked)
                if not whole and not (asked.column("kind").to_numpy() == 1).any():
                    mask[:] = False
                if len(rest) and mask.any():
                    return make(block, mask, rest)
            return empty

        empty, out = _empty(schema), None
        for s in self.segments:
            mine = asked.where(F.col("s") == s).select("s", "block", F.lit(0).alias("kind"), "name", "names", "weights", "least")
            if masks is not None:
                lists = masks.where(F.col("s") == s).select(
                    "s", "block", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), "names",
                    F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("double").alias("least"),
                )
                mine = mine.unionByName(lists)
            visited = asked.where(F.col("s") == s).select("block").distinct()
            rows = self._table(s, "blocks").join(visited, "block", "left_semi")
            part = rows.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(met, schema)
            out = part if out is None else out.unionByName(part)
        return out

    def _where(self, phrases: DataFrame) -> DataFrame:
        """(phrase, s, block): blocks that hold the word of each phrase that is in the fewest records."""
        words = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("term"))
        rows = words.join(self.term_rows(), "term")
        of_word = rows.groupBy("phrase", "term").agg(F.sum("n").alias("df"))
        rarest = of_word.groupBy("phrase").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
        return rarest.join(self.term_rows(), "term").select("phrase", "s", "block")

    def hits(self, phrases: DataFrame, served: DataFrame | None = None) -> DataFrame:
        """(phrase, record_id, tf, dl): occurrences of each phrase within single columns."""
        return self._phrases(phrases, served, _list_hits, "phrase string, record_id string, tf bigint, dl bigint")

    def doc_freq(self, phrases: DataFrame, served: DataFrame | None = None) -> DataFrame:
        """(phrase, df): records with each phrase, counted where they lie."""
        counted = self._phrases(phrases, served, _count_hits, "phrase string, n bigint")
        return counted.groupBy("phrase").agg(F.sum("n").alias("df"))

    def _phrases(self, phrases: DataFrame, served: DataFrame | None, make: Callable, schema: str) -> DataFrame:
        wanted = cut_lineage(phrases.select("phrase").distinct())
        # Many phrases of one block come in rows of bounded length.
        places = self._where(wanted).groupBy("s", "block", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share")).agg(F.collect_list("phrase").alias("names"))
        asked = places.select("s", "block", F.lit(None).cast("string").alias("name"), "names", F.lit(None).cast("array<double>").alias("weights"), F.lit(0.0).alias("least"))
        return self._visit(asked, served, make, schema, 1.0)

    def weights(self, wanted: DataFrame) -> tuple[DataFrame, float]:
        """((query_id, phrase, weight, df), average length) for (query_id, phrase, qtf): BM25 weights over all records."""
        n, average = self.totals()
        phrases = wanted.select("phrase").distinct()
        simple = len(self.segments) == 1
        several = phrases.where(F.contains("phrase", F.lit(" "))) if simple else phrases
        df = self.doc_freq(several)
        if simple:
            singles = phrases.where(~F.contains("phrase", F.lit(" "))).select(F.col("phrase").alias("term"))
            df = df.union(singles.join(self.term_rows(), "term").groupBy(F.col("term").alias("phrase")).agg(F.sum("n").alias("df")))
        idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("qtf") * F.when(idf > 0, idf).otherwise(F.lit(MIN_IDF))
        return wanted.join(df, "phrase").select("query_id", "phrase", weight.alias("weight"), "df"), average

    def topk(self, wanted: DataFrame, k: int, floor: float, served: DataFrame | None = None) -> DataFrame:
        """(query_id, record_id, score): every record that is among the k best of a query (query_id, phrase, qtf)
        by BM25, from ``floor`` on; exact, ties by id included."""
        weighed, average = self.weights(cut_lineage(wanted))
        weighed = cut_lineage(weighed)
        kind = weighed.schema["query_id"].dataType.simpleString()
        asking = cut_lineage(
            weighed.groupBy("query_id").agg(F.collect_list(F.struct("phrase", "weight")).alias("p"))
            .select(F.col("query_id").cast("string").alias("name"), F.col("p.phrase").alias("names"), F.col("p.weight").alias("weights"))
        )
        served = cut_lineage(served.select("record_id").distinct()) if served is not None else None
        # What a block can give at most, by the word of each phrase that is in the fewest records.
        top = F.col("max_tf").cast("double")
        norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("min_dl") / F.lit(average or 1.0))
        rare = weighed.where(F.col("df") <= RARE).select(F.col("query_id").cast("string").alias("name"), "phrase", "weight")
        met = rare.join(self._where_bound(rare.select("phrase").distinct(), top * (BM25_K1 + 1) / (top + norm)), "phrase")
        promise = met.groupBy("name", "s", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
        best = Window.partitionBy("name").orderBy(F.col("bound").desc(), "s", "block")
        first = cut_lineage(promise.withColumn("r", F.row_number().over(best)).where("r <= 2").select("name", "s", "block"))
        score = _best(k, floor)
        schema = "name string, record_id string, score double"
        known = cut_lineage(self._visit(asking.withColumn("least", F.lit(float(floor))).join(first, "name"), served, score, schema, average))
        reached = known.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "record_id"))).where(F.col("r") == k)
        least = reached.select("name", F.col("score").alias("kth"))
        found = known
        passes = max(1, -(-asking.count() // PASS))
        for i in range(passes):
            mine = asking.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == i).join(least, "name", "left")
            mine = mine.select("name", "names", "weights", F.greatest(F.coalesce("kth", F.lit(float(floor))), F.lit(float(floor))).alias("least"))
            # Every block that holds a phrase heavy enough for the bound is visited; inside, the block's own bound decides.
            asked = self._reachable(mine, average).join(first, ["name", "s", "block"], "left_anti")
            found = found.union(cut_lineage(self._visit(asked, served, score, schema, average)))
        return found.select(F.col("name").cast(kind).alias("query_id"), "record_id", "score")

    def _where_bound(self, phrases: DataFrame, most) -> DataFrame:
        """(phrase, s, block, most): a bound of each phrase's part in each block that may hold it."""
        words = phrases.select("phrase", F.split("phrase", " ")[0].alias("term"))
        return words.join(self.term_rows(), "term").select("phrase", "s", "block", most.alias("most"))

    def _reachable(self, asking: DataFrame, average: float) -> DataFrame:
        """Visits (name, names, weights, least, s, block) that can reach a query's ``least``.

        The lightest phrases, which together stay below it wherever they are, don't lead to a block.
        """
        each = asking.select("name", "least", F.explode(F.arrays_zip("names", "weights")).alias("p")).select("name", "least", F.col("p.names").alias("phrase"), F.col("p.weights").alias("weight"))
        highest = cut_lineage(self._highest(each.select("phrase").distinct(), average))
        reach = Window.partitionBy("name").orderBy(F.col("weight") * F.col("most"), "phrase").rowsBetween(Window.unboundedPreceding, 0)
        heavy = each.join(highest, "phrase").withColumn("reach", F.sum(F.col("weight") * F.col("most")).over(reach)).where(F.col("reach") + 1e-6 >= F.col("least"))
        words = cut_lineage(heavy.select("name", F.split("phrase", " ")[0].alias("term")).distinct())
        blocks = words.join(self.term_rows().select("term", "s", "block"), "term").select("name", "s", "block").distinct()
        return asking.join(blocks, "name")

    def _highest(self, phrases: DataFrame, average: float) -> DataFrame:
        """(phrase, most): a bound of each phrase's part in any record."""
        top = F.col("max_tf").cast("double")
        norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("min_dl") / F.lit(average or 1.0))
        return self._where_bound(phrases, top * (BM25_K1 + 1) / (top + norm)).groupBy("phrase").agg(F.max("most").alias("most"))


def _empty(schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def _list_hits(block: _Block, mask: np.ndarray, asked: pa.Table) -> pa.Table:
    names, at, tf = [], [], []
    for phrases in asked.column("names").to_pylist():
        for p in phrases:
            a, f = block.hits(p)
            keep = mask[a]
            names += [p] * int(keep.sum())
            at.append(a[keep])
            tf.append(f[keep])
    every = np.concatenate(at) if at else np.zeros(0, np.int32)
    return pa.table(
        {
            "phrase": pa.array(names, pa.string()), "record_id": block.ids.take(pa.array(every)),
            "tf": pa.array(np.concatenate(tf).astype(np.int64) if tf else [], pa.int64()), "dl": pa.array(block.lengths[every].astype(np.int64)),
        }
    )


def _count_hits(block: _Block, mask: np.ndarray, asked: pa.Table) -> pa.Table:
    rows = [(p, int(mask[block.hits(p)[0]].sum())) for phrases in asked.column("names").to_pylist() for p in phrases]
    rows = [r for r in rows if r[1]]
    return pa.table({"phrase": pa.array([r[0] for r in rows], pa.string()), "n": pa.array([r[1] for r in rows], pa.int64())})


def _best(k: int, floor: float) -> Callable:
    def best(block: _Block, mask: np.ndarray, asked: pa.Table) -> pa.Table:
        names, at, scores = [], [], []
        columns = (asked.column(c).to_pylist() for c in ("name", "names", "weights", "least"))
        for name, phrases, weights, least in zip(*columns, strict=True):
            s = block.scores(phrases, np.array(weights), least - 1e-6)
            if s is None:
                continue
            ok = np.flatnonzero(mask & (s > 0) & (s >= max(floor, least)))
            if len(ok) > k:
                ok = ok[s[ok] >= np.partition(s[ok], -k)[-k]]
                ok = ok[np.lexsort((ok, -s[ok]))][:k]
            names += [name] * len(ok)
            at.append(ok)
            scores.append(s[ok])
        every = np.concatenate(at) if at else np.zeros(0, np.int64)
        return pa.table(
            {"name": pa.array(names, pa.string()), "record_id": block.ids.take(pa.array(every)), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())}
        )

    return best


def _unfold(key: tuple, rows: pa.Table) -> pa.Table:
    """Records of a block from its postings, those in ``names`` only."""
    rows = rows.combine_chunks()
    terms = rows.column("term").to_pylist()
    head = terms.index(None)
    ids, lengths = rows.column("ids")[head].as_py(), rows.column("lengths")[head].as_py()
    kept = set(rows.column("names")[head].as_py())
    fields: list[dict[int, list]] = [{} for _ in ids]
    for term, places in zip(terms, rows.column("places").to_pylist(), strict=True):
        if term is not None:
            for p in np.frombuffer(places, np.int64).tolist():
                fields[p >> 40].setdefault(p >> 32 & 255, []).append((p & 0xFFFFFFFF, term))
    out = []
    for i, name in enumerate(ids):
        if name in kept:
            columns = [[t for _, t in sorted(fields[i].get(c, []))] for c in range(max(fields[i], default=-1) + 1)]
            out.append((name, columns, lengths[i]))
    return pa.table(
        {
            "record_id": pa.array([r[0] for r in out], pa.string()), "fields": pa.array([r[1] for r in out], pa.list_(pa.list_(pa.string()))),
            "dl": pa.array([r[2] for r in out], pa.int64()),
        }
    )
