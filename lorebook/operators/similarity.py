"""Near-copy detection by word-shingle containment, and the guards built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .records import _strings

# Shingle size, containment threshold and the generic task words that never
# count as distinctive.
SHINGLE = 5
THRESHOLD = 0.15
GENERIC_TASK_WORDS = (
    "with that this then when code your from into have will must only also does test file line "
    "true false null value values using used uses should return returns function write program "
    "example input output error errors type types print prints takes result number string strings "
    "title symptom summary"
).split()


def authored_prose() -> Column:
    """Narrative text of a record: everything human-written except signatures and repros."""
    dead_ends = F.coalesce(
        F.col("resolution.dead_ends"), F.array().cast("array<struct<tried:string,why_it_failed:string>>")
    )
    opt = lambda c: F.nullif(X.col(c), F.lit(""))
    return X.utrim(
        F.concat_ws(
            "\n", opt("title"), opt("symptom.summary"), opt("resolution.root_cause"), opt("resolution.fix"),
            F.flatten(F.transform(dead_ends, lambda d: F.array(opt(d["tried"]), opt(d["why_it_failed"])))),
            opt("body"),
        )
    )


def containment_join(drafts: DataFrame, refs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, with_matches: bool = False) -> DataFrame:
    """(draft_id, ref_id, shared, total, containment [, matches]) of every pair at the threshold.

    ``drafts`` is (draft_id, text), ``refs`` is (ref_id, text).  Identical texts are compared once
    and fanned out at the end.  Only shingles of both sides count, so those of the side with less text
    are stored and the other side's are filtered where its texts lie.  A draft needs ``need`` of its
    shingles in a reference, so of those that occur in any reference, the rarest m - need + 1 must hold
    one of them: only these meet the references, and a passage that most texts share does not.
    Candidates are verified on all that both sides hold.  ``matches`` is the sorted list of shared shingles.
    """
    keyed = lambda df, i, key: df.select(i, F.sha2("text", 256).alias(key), "text")
    d, r = keyed(drafts, "draft_id", "draft_key"), keyed(refs, "ref_id", "ref_key")
    length = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if length(d) <= length(r):
        left = _shingled(d, "draft_key", n)
        right = _shingled(r, "ref_key", n, left)
    else:
        right = _shingled(r, "ref_key", n)
        left = _shingled(d, "draft_key", n, right)
    frequency = cut_lineage(right.groupBy("h").agg(F.count("*").alias("df")))
    # The least count that reaches the threshold by the comparison made at the end.
    least = F.ceil(F.col("total") * F.lit(threshold))
    need = F.greatest(F.when((least - 1) / F.col("total") >= threshold, least - 1).when(least / F.col("total") >= threshold, least).otherwise(least + 1), F.lit(1))
    known = (
        left.withColumn("need", need).join(frequency, "h")
        .groupBy("draft_key").agg(F.max("need").alias("need"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found"))
        .where(F.size("found") >= F.col("need"))
    )
    known = cut_lineage(known.select("draft_key", "need", "total", F.col("found.h").alias("a")))
    rarest = known.select("draft_key", F.explode(F.slice("a", F.lit(1), (F.size("a") - F.col("need") + 1).cast("int"))).alias("h"))
    pairs = rarest.join(right.select("ref_key", "h"), "h").select("draft_key", "ref_key").distinct()
    held = right.groupBy("ref_key").agg(F.collect_list("h").alias("b"))
    sets = pairs.join(known.select("draft_key", "total", "a"), "draft_key").join(held, "ref_key")
    rated = sets.select("draft_key", "ref_key", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"), "total")
    flagged = rated.withColumn("containment", F.col("shared") / F.col("total")).where(F.col("containment") >= threshold)
    out = flagged.join(d.select("draft_id", "draft_key"), "draft_key").join(r.select("ref_id", "ref_key"), "ref_key")
    columns = ["draft_id", "ref_id", "shared", "total", "containment"]
    if not with_matches:
        return out.select(*columns)
    words = lambda df, i, name: df.select(i, X.words("text").alias("w")).select(i, X.shingles("w", n).alias(name))
    texts = out.select(*columns).join(words(drafts, "draft_id", "a"), "draft_id").join(words(refs, "ref_id", "b"), "ref_id")
    return texts.select(*columns, F.array_sort(F.array_intersect("a", "b")).alias("matches"))


def _shingled(df: DataFrame, key: str, n: int, among: DataFrame | None = None) -> DataFrame:
    """(key, total, h): the distinct shingles of each different text as hashes, or those found in ``among``,
    and how many the text has; stored."""
    # No filter on the arrays, and an outer explode, which adds none: a filter would be moved below and
    # evaluate the expressions once more.
    hashed = df.select(key, X.words("text").alias("w")).select(key, F.transform(X.shingles("w", n), lambda x: F.xxhash64(x)).alias("s"))
    each = hashed.withColumn("total", F.size("s")).select(key, "total", F.explode_outer("s").alias("h"))
    if among is not None:
        # Stored, so that its size in bytes decides whether it is sent to the texts.
        each = each.join(cut_lineage(among.select("h").distinct()), "h", "left_semi")
    return cut_lineage(each.select(key, "total", "h").where(F.col("h").isNotNull()).distinct())


def _distinctive(w: Column) -> Column:
    return (F.octet_length(w) >= 4) & ~w.isin(*GENERIC_TASK_WORDS) & ~w.rlike(r"^\p{Nd}+\z")


def distinctive_terms(c) -> Column:
    """Distinct words of at least four bytes that are neither generic task words nor numbers."""
    return F.array_distinct(F.filter(X.words(c), _distinctive))


def _contained(n: int):
    """Share of the distinct n-grams of a prompt that a fix holds, of their blank-joined words."""

    def grams(text):
        words = text.split()
        return zip(*[words[i:] for i in range(n)])

    def contained(prompt, fix):
        ours = set(grams(prompt or ""))
        return len(ours.intersection(grams(fix))) / len(ours) if ours else 0.0

    return contained


def leak_and_relevance_guard(tasks: DataFrame, records: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(task_id, record_id, containment, verdict): leak, irrelevant or ok for each drafted task.

    ``tasks`` is (task_id, record_id, prompt); ``records`` are nested records.  Only texts are shuffled; their
    shingles, many times as large, are made behind the join and compared word by word, which costs less than
    joining them to strings.  Terms are only looked at where nothing leaks.
    A record without distinctive terms finds every task relevant.
    """
    packages = F.transform("applies_to", lambda a: F.coalesce(a["package"], F.lit("")))
    vocabulary = F.concat_ws(
        " ", "title", "symptom.summary", _strings("symptom.error_signatures"), F.coalesce(packages, F.array().cast("array<string>"))
    )
    fix_text = F.concat_ws(" ", F.coalesce("resolution.root_cause", F.lit("")), F.coalesce("resolution.fix", F.lit("")))
    facts = records.select(F.col("id").alias("record_id"), fix_text.alias("fix"), vocabulary.alias("vocabulary"))
    keys = ["task_id", "record_id"]
    joined = lambda c: F.array_join(X.words(c), " ")
    words = tasks.join(facts, "record_id").select(*keys, "vocabulary", joined("prompt").alias("p"), joined("fix").alias("f"))
    rated = words.select(*keys, "vocabulary", "p", F.udf(_contained(max(n, 1)), "double")("p", "f").alias("containment"))
    terms = X.words("vocabulary")
    relevant = F.exists(F.array_intersect(F.split("p", " "), terms), _distinctive) | ~F.exists(terms, _distinctive)
    return rated.select(
        *keys, "containment", F.when(F.col("containment") >= threshold, "leak").when(~relevant, "irrelevant").otherwise("ok").alias("verdict")
    )
