"""Conversation prefix trie by truncation peeling.

Conversations are reduced to keys of their turns' prefixes.  The deepest ones come first: at each
depth the conversations that end there are merged with the nodes that survive from below, every
node gets its members, leaves and savings from one aggregate by prefix, and its last turn is
stripped before the next depth.  Two things bound the rounds and the work:

* The part of a conversation that no other one shares is cut off first, as its nodes have one
  member each; rounds are as many as the deepest *shared* depth, whatever the longest conversation.
* Positions come from a range-partitioned sort and prefix keys from blocks of turns with carried
  offsets, so one conversation with a third of all turns is dealt over many tasks, as is a node with
  a third of all members (partial aggregates; ids hashed as a stream of sorted chunks).

Texts are read once; what is shuffled are 128-bit digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .shared import few_rows, ranked, stored, word_count

# A conversation is rebuilt on the opening of the first one of its family of so many ids.
FAMILY, HEADS = 20, 4
# Turns of one conversation whose keys are chained in one window.
BLOCK = 4096
# Ids in one piece of a node's list of ended conversations.
PIECE = 4096
KEY = "struct<x: bigint, y: bigint>"
PATH = f"array<struct<d: bigint, k: {KEY}, words: bigint>>"
RESULT = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, p, digest, words): the turns of each conversation by place from 0, stored.

    Ordered by turn, null first; turns that tie, by the digest of role and text.  Null role and
    text are empty; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    narrow = stored(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
            word_count("text").alias("words"),
        )
    )
    order = [F.col("c").asc(), F.col("t").asc_nulls_first(), F.col("digest").asc()]
    in_order = stored(ranked(narrow, order, "r"))
    first = in_order.groupBy("c").agg(F.min("r").alias("first"))
    return stored(in_order.join(first, "c").select("c", (F.col("r") - F.col("first")).alias("p"), "digest", "words"))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((c, n), (c, p, digest, words)): conversations with their number of turns, and their turns, after
    the first h turns of c are replaced by those of c - c % family; h = crc32(c) % heads."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).alias("h")
    own = turns.groupBy("c").agg(F.count("*").alias("own"))
    opening = turns.where((F.col("c") % family == 0) & (F.col("p") < heads - 1)).groupBy(F.col("c").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("p", "digest", "words"))).alias("opening")
    )
    plan = own.select("c", "own", h, (F.col("c") - F.col("c") % family).alias("base")).join(opening, "base", "left")
    none = F.expr("array()").cast("array<struct<p: bigint, digest: string, words: bigint>>")
    plan = plan.select("c", "own", "h", F.slice(F.coalesce("opening", none), 1, F.col("h").cast("int")).alias("head"))
    plan = stored(plan.withColumn("n", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    head = plan.select("c", F.explode("head").alias("t")).select("c", "t.p", "t.digest", "t.words")
    shift = plan.select("c", "h", F.size("head").alias("k"))
    tail = turns.join(shift, "c").where(F.col("p") >= F.col("h")).select("c", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "digest", "words")
    return plan.select("c", F.col("n").cast("long").alias("n")), head.union(tail)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, k, words): each turn with its depth d from 1 and the 128-bit key k of the first d turns, stored.

    A key combines one hash of (place, turn) per turn, so blocks of turns are chained apart and
    moved by the combined hashes of the blocks before them.
    """
    marked = turns.select(
        "c", "p", "words", F.floor(F.col("p") / BLOCK).alias("b"), F.xxhash64("p", "digest").alias("x"), F.xxhash64("digest", "p").alias("y")
    )
    upto = Window.partitionBy("c", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    chained = marked.select("c", "b", "p", "words", F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"))
    # Only conversations of several blocks have anything to carry.
    full = marked.where(F.col("p") % BLOCK == BLOCK - 1).select("c", "b").alias("f")
    sums = marked.join(full, ["c", "b"], "left_semi").groupBy("c", "b").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    carried = sums.select("c", (F.col("b") + 1).alias("b"), F.bit_xor("x").over(before).alias("bx"), F.bit_xor("y").over(before).alias("by"))
    moved = chained.join(carried, ["c", "b"], "left")
    x, y = (F.col(v).bitwiseXOR(F.coalesce(F.col(f"b{v}"), F.lit(0).cast("long"))) for v in "xy")
    return stored(moved.select("c", (F.col("p") + 1).alias("d"), F.struct(x.alias("x"), y.alias("y")).alias("k"), "words"))


def _by_depth(df: DataFrame) -> str:
    """Write a table with a folder for each value of its column ``at``, so that a round reads its own rows only."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy("at").parquet(path)
    return path


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows as (key, first id, ids joined by commas), at most ``PIECE`` ids in a piece."""
    done: list[tuple[str, int, str]] = []
    key, ids = None, []
    for b in few_rows(batches, 8 * PIECE):
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                done.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        if done:
            yield pa.record_batch([pa.array(v) for v in zip(*done, strict=True)], ["k", "first", "ids"])
            done = []
    if ids:
        yield pa.record_batch([pa.array([v]) for v in (key, ids[0], ",".join(map(str, ids)))], ["k", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one SHA-256 for each key; only the running state is held."""
    key, state = None, None
    for b in few_rows(batches):
        done = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["k", "sha"])
    if state is not None:
        yield pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], ["k", "sha"])


def _packed(k: str) -> Column:
    """A key as one sortable string, or the root's."""
    return F.coalesce(F.concat(F.hex(f"{k}.x"), F.lit("."), F.hex(f"{k}.y")), F.lit("root"))


def _entry_key() -> Column:
    """Packed key of the node at which an item of the peel enters."""
    last = F.element_at("path", -1)["k"]
    return F.when(F.col("path").isNull(), F.lit("root")).otherwise(F.concat(F.hex(last["x"]), F.lit("."), F.hex(last["y"])))


def ended_digests(ends: DataFrame) -> DataFrame:
    """(k, sha) for the ends (k, c): SHA-256 of the ascending decimal ids, comma-joined.  A node's ids are
    joined in pieces wherever the sort put them; only pieces meet in one task, as a sorted stream."""
    pieces = ends.repartitionByRange("k", "c").sortWithinPartitions("k", "c").mapInArrow(_pieces, "k string, first bigint, ids string")
    return pieces.repartition("k").sortWithinPartitions("k", "first").mapInArrow(_digests, "k string, sha string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row for each distinct sequence of first d turns (role, text) of the rebuilt conversations,
    the empty one included: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the node one turn shorter,
    ``n_leaves`` and ``saved_tokens`` (words of a node's last turn, once for each member but the first)
    cover the subtree.  A conversation that is left without turns is a member of the root.  Rows
    without conv_id are ignored; repeated rows are repeated turns; empty input gives an empty
    result.  Negative ids keep the sign of their remainder.  Other columns are not read.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(turns_of(conversations), family, heads)
    convs = stored(convs)
    steps = prefixes(turns)

    # Where a conversation's shared part ends.  Half of the key is enough: a chance hit only moves the cut down.
    shared = steps.groupBy("k.x").agg(F.count("*").alias("n")).where("n > 1").select(F.col("x").alias("sx"))
    cut = steps.join(shared, F.col("k.x") == F.col("sx"), "left_semi").groupBy("c").agg(F.max("d").alias("cut"))
    convs = stored(convs.join(cut, "c", "left").select("c", "n", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")))
    cutting = steps.join(convs, "c")
    path = cutting.where("d <= cut").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "k", "words"))).alias("path"))
    tailed = F.col("n") > F.col("cut")
    items = convs.join(path, "c", "left").select(
        F.col("cut").alias("at"), "path", F.col("c").alias("conv_id"), F.lit(1).cast("long").alias("n_convs"),
        *[F.when(tailed, 1).otherwise(0).cast("long").alias(x) for x in ("n_children", "leaves")],
        F.lit(0).cast("long").alias("saved"), tailed.alias("tailed"),
    )
    where = _by_depth(items)
    entering = spark.read.schema(items.schema).parquet(where)
    depths = [r.at for r in convs.groupBy(F.col("cut").alias("at")).agg(F.lit(1)).select("at").collect()]

    # Peel from the deepest shared depth: ended conversations join the survivors of the depth below.
    no_key, no_path = F.lit(None).cast(KEY), F.lit(None).cast(PATH)
    columns = ["path", "conv_id", "n_convs", "n_children", "leaves", "saved"]
    levels, survivors = [], None
    for d in range(max(depths, default=-1), -1, -1):
        here = entering.where(F.col("at") == d).select(*columns)
        met = here if survivors is None else survivors if d not in depths else here.union(survivors)
        last = F.element_at("path", d) if d else F.lit(None)
        node = (
            met.withColumn("k", last["k"] if d else no_key)
            .groupBy("k").agg(
                F.first("path").alias("path"), F.min("conv_id").alias("conv_id"),
                *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "leaves", "saved")],
            )
        )
        saving = (F.col("n_convs") - 1) * (F.element_at("path", d)["words"] if d else F.lit(0))
        node = node.select(
            F.lit(d).cast("long").alias("depth"), "k",
            (F.element_at("path", d - 1)["k"] if d > 1 else no_key).alias("parent"),
            (F.slice("path", 1, d - 1) if d > 1 else no_path).alias("path"),
            "conv_id", "n_convs", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + saving).cast("long").alias("saved"),
        )
        node = stored(node)
        levels.append(node.drop("path"))
        survivors = node.select("path", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "leaves", "saved")
    if not levels:
        return spark.createDataFrame([], RESULT)
    merged = levels[0]
    for level in levels[1:]:
        merged = merged.union(level)

    # Nodes of unshared tails: one member, and a chain down to their end.
    alone = cutting.where("d > cut").select(
        F.col("d").alias("depth"), F.when(F.col("d") > F.col("cut") + 1, F.col("c")).alias("known"), "c", (F.col("d") == F.col("n")).alias("last")
    )
    ends = ended_digests(entering.where("NOT tailed").select(_entry_key().alias("k"), F.col("conv_id").alias("c")))
    named = merged.select(_packed("k").alias("at"), F.col("conv_id").alias("above"))
    hashed = merged.withColumn("key", _packed("k")).join(ends.select(F.col("k").alias("key"), "sha"), "key", "left")
    whole = hashed.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, _packed("parent")).alias("up"), F.lit(None).cast("long").alias("known"),
        "n_convs", "n_children", "leaves", "saved", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )
    top = entering.where("tailed").select(F.col("conv_id").alias("c"), _entry_key().alias("up"))
    one = F.lit(1).cast("long")
    single = alone.where("known IS NULL").join(top, "c").unionByName(alone.where("known IS NOT NULL").withColumn("up", F.lit(None).cast("string"))).select(
        F.col("c").alias("conv_id"), "depth", "up", "known", one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("last"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return whole.union(single).join(named, F.col("up") == F.col("at"), "left").select(
        "conv_id", "depth", F.coalesce("known", "above").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# 3988292384 is the reversed polynomial of CRC-32; its table follows from the rule.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT n, n AS v, 0 AS i FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE i = 8),
said AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS p, digest, words FROM said),
ids AS (SELECT DISTINCT c, hex(encode(CAST(c AS VARCHAR))) AS x FROM t),
convs AS (SELECT c, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % {HEADS} AS h FROM ids, crc),
built AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, digest, words FROM (
  SELECT v.c, 0 AS part, t.p, digest, words FROM convs v JOIN t ON t.c = v.c - v.c % {FAMILY} AND t.p < v.h
  UNION ALL SELECT v.c, 1, t.p, digest, words FROM convs v JOIN t ON t.c = v.c AND t.p >= v.h)),
keyed AS (
  SELECT c, d, words, md5(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM built
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS w FROM keyed GROUP BY k, d),
links AS (SELECT n.k, p.k AS up FROM nodes n JOIN keyed p ON p.c = n.conv_id AND p.d = n.d - 1),
children AS (SELECT up AS k, count(*) AS n_children FROM links GROUP BY up),
sized AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (k)),
sub AS (SELECT a.k, sum((s.n - 1) * s.w) AS saved, count(*) FILTER (s.n_children = 0) AS leaves
  FROM sized s JOIN keyed a ON a.c = s.conv_id AND a.d <= s.d GROUP BY a.k),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ended
  FROM keyed JOIN (SELECT c, max(d) AS d FROM keyed GROUP BY c) USING (c, d) GROUP BY k)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(s.n AS BIGINT) AS n_convs, CAST(s.n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256
FROM sized s JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN links l USING (k) LEFT JOIN nodes p ON p.k = l.up
"""
