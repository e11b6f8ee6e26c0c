"""Sinks: pilot report CSV, frequency tables, pack tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rights import DEFAULT_POLICY, pack_tables

# Header of the pilot report.
PILOT_COUNTS = (
    "decisions exposed_decisions exposures judged used confirmed incorrect error_decisions repeated_errors"
).split()
PILOT_RATES = (
    "hit_rate hit_low_95 hit_high_95 outcome_coverage outcome_coverage_low_95 outcome_coverage_high_95 "
    "used_rate used_low_95 used_high_95 helpful_rate helpful_low_95 helpful_high_95 "
    "incorrect_rate incorrect_low_95 incorrect_high_95 "
    "repeated_error_rate repeated_error_low_95 repeated_error_high_95"
).split()
SCOPES = ("aggregate", "team", "record")


def pilot_rows(report: DataFrame) -> DataFrame:
    """The report as text columns in header order: six-decimal rates, blanks where undefined.

    A rate is rounded from its exact binary value, half to even, as C and Go do; ``format_string`` rounds the
    shortest decimal up instead.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rate = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.translate(F.format_number(F.col(c), 6), ",", ""))
    return report.select(
        "scope", "arm", "team", "record_id",
        *[text(c).alias(c) for c in PILOT_COUNTS],
        *[rate(c).alias(c) for c in PILOT_RATES],
    )


def write_pilot_csv(report: DataFrame, path: str) -> None:
    """Report rows ordered by scope, team, record and arm, in sorted CSV parts."""
    scope = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    pilot_rows(report).orderBy(scope, "team", "record_id", "arm").write.mode("errorifexists").option("header", "true").option(
        "emptyValue", ""
    ).csv(path)


def idf_lines(idf: DataFrame, total: int) -> DataFrame:
    """(value): the table as text lines: a document-count header, then words by falling df."""
    spark = idf.sparkSession
    header = spark.createDataFrame([(0, f"docs\t{total}")], "o int, value string")
    rows = idf.select(F.lit(1).alias("o"), F.concat("word", F.lit("\t"), F.col("df").cast("string")).alias("value"), "df", "word")
    both = header.withColumn("df", F.lit(0).cast("bigint")).withColumn("word", F.lit("")).unionByName(rows)
    return both.orderBy("o", F.col("df").desc(), "word").select("value")


def write_idf(idf: DataFrame, total: int, path: str) -> None:
    """gzip text parts in order; the first line of the first part is the header."""
    idf_lines(idf, total).write.mode("errorifexists").option("compression", "gzip").text(path)


def read_idf(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(table, total documents); words are lower-cased."""
    fields = F.split("value", "\t", 2)
    # Parts are named in the order of their lines, whatever order they are read in.
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"))
    rows = spark.read.text(path).where(F.col("value") != "").select(fields[0].alias("word"), fields[1].cast("bigint").alias("df"), place.alias("_p"))
    header = rows.agg(F.min(F.struct("_p", "word", "df")).alias("h")).first()["h"]
    if header is None or header["word"] != "docs" or header["df"] is None:
        raise ValueError("frequency table without a docs header")
    first = F.struct(*[F.lit(header["_p"][k]).alias(k) for k in ("f", "s", "i")])
    body = rows.where(F.col("_p") != first)
    return body.groupBy(F.lower("word").alias("word")).agg(F.max("df").alias("df")), int(header["df"])


def pack_manifest(records: DataFrame, path: str, commercial: bool = True, policy: str = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write included / excluded / attribution tables under ``path`` and return them as read back."""
    names = ("included", "excluded", "attribution")
    for name, table in zip(names, pack_tables(records, commercial, policy=policy)):
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = records.sparkSession
    return tuple(spark.read.parquet(f"{path}/{name}") for name in names)
