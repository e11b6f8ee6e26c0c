"""Driver tables, and reference-shaped tables derived from them.

Each derivation has its SQL twin in :mod:`sqltext`; both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ingest import typed
from ..operators.inverted import StoredIndex
from ..operators.retrieval import CorpusIndex, token_index
from ..session import ensure_checkpoint_dir


# Tables with heavy per-row work, and the key that spreads them.
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "embeddings": "vec_id"}


# Bytes of a table's files that one task takes when it counts terms.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """The driver's tables come as one row group each; this gives the texts among them their
    parallelism.  A table of as many partitions as there are cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


KIND_OF_LANG = {"en": "trap", "de": "fix", "fr": "dead-end", "es": "convention"}


def status_column() -> Column:
    q, t = F.col("quality"), F.col("toxic")
    return (
        F.when(q.isNull(), "quarantined")
        .when((q == 1) & (t == 0), "validated")
        .when(q == 1, "disputed")
        .when(t == 0, "stale")
        .otherwise("superseded")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat corpus: one record per document, its status from the labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF_LANG.items() for x in kv])
    lines = F.split("text", "\n")
    lic = (
        F.when(F.contains("text", F.lit("Apache License")), "Apache-2.0")
        .when(F.contains("text", F.lit("MIT License")), "MIT")
        .when(F.contains("text", F.lit("GNU General Public License")), "GPL-3.0")
        .when(F.contains("text", F.lit("CC BY-NC")), "CC-BY-NC-4.0")
        .when(F.col("lang") == "es", "none (facts only)")
        .when(F.col("lang") == "de", "none (authored, internal-only)")
        .otherwise("")
    )
    return docs.select(
        "doc_id",
        X.record_id("doc_id").alias("id"),
        kinds[F.col("lang")].alias("kind"),
        status_column().alias("status"),
        lines[0].alias("title"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("summary"),
        F.slice(lines, 3, 1 << 30).alias("signatures"),
        F.col("text").alias("body"),
        "lang",
        "source",
        F.when(F.col("lang") == "es", F.concat(F.lit("alpha:"), "source")).otherwise(F.col("source")).alias("author"),
        lic.alias("source_license"),
        F.when(F.contains("text", F.lit("http")) | (lic == "Apache-2.0"), F.concat(F.lit("https://example.org/"), "source")).otherwise(F.lit("")).alias("source_url"),
        F.concat(F.lit("experience/2024/"), F.regexp_replace(X.record_id("doc_id"), "^exp-", ""), F.lit("-"), "source", F.lit(".md")).alias("path"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of the corpus; root cause is the summary line and the fix the third line on."""
    c = corpus(spark, sf_dir)
    none = F.lit(None)
    s = lambda c_, n: c_.cast("string").alias(n)
    return typed(
        c.select(
            F.lit(1).alias("schema_version"), "id", "kind", "status", "title",
            F.struct(
                F.col("summary").alias("summary"), F.col("signatures").alias("error_signatures"),
                none.cast("struct<app:array<string>,generic:array<string>>").alias("fingerprints"),
            ).alias("symptom"),
            F.array(
                F.struct(
                    F.col("lang").alias("ecosystem"), F.col("source").alias("package"),
                    none.cast("struct<introduced:string,fixed:string>").alias("versions"),
                    none.cast("map<string,string>").alias("runtime"),
                )
            ).alias("applies_to"),
            F.struct(
                F.col("summary").alias("root_cause"), F.array_join("signatures", "\n").alias("fix"),
                none.cast("array<struct<tried:string,why_it_failed:string>>").alias("dead_ends"),
            ).alias("resolution"),
            none.cast("struct<repro:string,repros:array<struct<path:string,kind:string,label:string>>,guarding_test:string>").alias("guard"),
            _provenance().alias("provenance"),
            "body", "path",
        )
    )


def _provenance() -> Column:
    from pyspark.sql.types import StructType

    from ..schemas import RECORD

    ptype = StructType.fromDDL(RECORD)["provenance"].dataType
    author = F.struct(
        F.col("author").alias("author"), F.lit(None).cast("string").alias("session"), F.lit(None).cast("string").alias("pr")
    )
    given = {
        "source": author,
        "recorded_at": F.lit("2024-01-01"),
        "validated_at": F.when(F.col("status") == "validated", F.lit("2024-02-01")),
        "valid": F.struct(F.lit("2024-01-01").alias("from"), F.lit(None).cast("string").alias("until")),
        "source_license": F.col("source_license"),
        "source_url": F.col("source_url"),
    }
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ptype.fields])


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token index over document bodies, its records dealt over partitions of bounded size: what a task
    counts per record stays within it, and needs no other shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    bodies = docs.select(X.record_id("doc_id").alias("record_id"), F.col("text").alias("body"))
    return token_index(bodies.repartition(parts, "record_id"), ["body"])


def stored_tokens(spark: SparkSession, sf_dir: str, fresh: bool = False) -> StoredIndex:
    """The stored index over document bodies, built by the first query that needs it.

    It lies in the shared folder under a digest of the table's files (path, size, time of change), so a
    changed table gets an index of its own; ``fresh`` builds it anew.
    """
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*meta).distinct()
    digest = files.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *files.columns))), ",").cast("binary")).alias("m")).first()["m"]
    root = f"{ensure_checkpoint_dir(spark)}/index-{digest}"
    found = None if fresh else StoredIndex.open(spark, root)
    return found or StoredIndex.build(document_tokens(spark, sf_dir), root)


def document_index(spark: SparkSession, sf_dir: str, vectors: bool = False, tokens: bool = True) -> CorpusIndex:
    """Corpus index whose only signature is the whole document text."""
    c = corpus(spark, sf_dir)
    flat = c.select(
        F.col("id").alias("record_id"), "kind", "status", "title", "summary", "path", F.lower("author").alias("origin")
    )
    fps = c.select(X.generic_fingerprint("body").alias("fp"), F.lit("generic").alias("scope"), F.col("id").alias("record_id"))
    applies = c.select(F.col("id").alias("record_id"), F.col("lang").alias("ecosystem"), F.col("source").alias("package"))
    vecs = None
    if vectors:
        vecs = table(spark, sf_dir, "embeddings").select(X.record_id("vec_id").alias("record_id"), F.col("embedding").alias("vec"))
    return CorpusIndex(flat, fps, applies, document_tokens(spark, sf_dir) if tokens else None, vecs)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a query; system turns count as error-triggered."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        "text",
        (F.col("role") == "system").alias("error_trigger"),
    )
