"""Landed feed files: advisories, release cycles, package metadata, changelogs, READMEs, background text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import S
from ..schemas import EOL_CYCLE, OSV, PACKAGE_META
from ..session import cut_lineage

# Feed patterns and licence allowlist.
RELEASE_HEADING = r"^## \d{4}-\d{2}-\d{2}, Version ([^\t\n\f\r ]+)"
SEMVER_MAJOR = (
    rf"\*\*\(SEMVER-MAJOR\)\*\*{S}*\*\*([^*]+)\*\*:{S}*(.+?){S}*\(([^()]+)\){S}*\[#\d+\]\(([^)]+)\){S}*\z"
)
CODE_FENCE = r"(?isu)```(?:js|javascript|py)[\t\n\f\r ]*\n(.*?)```"
EXAMPLES_START = "# 👀 Examples"
EXAMPLES_END = ("\n# Contributing", "\n# 📚 Other resources")
EXPLANATION = {"## ": r"(?isu)###[\t\n\f\r ]*💡[\t\n\f\r ]*Explanation:?[\t\n\f\r ]*\n(.*)",
               "### ▶ ": r"(?isu)####[\t\n\f\r ]*💡[\t\n\f\r ]*Explanation:?[\t\n\f\r ]*\n(.*)"}
SKIPPED_TITLES = ("👀 Examples", "Table of Contents")
BACKGROUND_LICENSES = (
    "MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Python-2.0", "Unlicense", "CC-BY-4.0",
)

# Most folders that a manifest may name.
MANIFEST_PATHS = 10_000


def read_osv(spark: SparkSession, path: str, ecosystem: str) -> DataFrame:
    """Advisories of one ecosystem: withdrawn, id-less and foreign ones dropped, foreign blocks removed."""
    return live_advisories(spark.read.schema(OSV).option("multiLine", "true").option("recursiveFileLookup", "true").json(path), ecosystem)


def live_advisories(rows: DataFrame, ecosystem: str) -> DataFrame:
    """:func:`read_osv` over a table of advisories."""
    mine = F.filter("affected", lambda a: F.substring_index(a["package"]["ecosystem"], ":", 1) == ecosystem)
    return (
        rows.where(X.is_blank("withdrawn") & ~X.is_blank("id"))
        .withColumn("affected", mine)
        .where(F.size("affected") > 0)
    )


def past_cycles(cycles: DataFrame, as_of: str) -> DataFrame:
    """(product, cycle, ended_on) of cycles already past their end; null date when only flagged."""
    eol = F.lower(X.utrim(F.coalesce("eol", F.lit(""))))
    date = X.strict_date(X.utrim("eol"))
    past = (eol == "true") | F.coalesce(date <= F.lit(as_of).cast("date"), F.lit(False))
    return cycles.where(~X.is_blank("cycle") & past).select("product", X.utrim("cycle").alias("cycle"), date.alias("ended_on"))


def read_eol_cycles(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """Release cycles from one ``<product>.json`` per product; only past ones when ``as_of`` is given."""
    rows = spark.read.schema(EOL_CYCLE).option("multiLine", "true").json(path)
    product = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    cycles = rows.select(product.alias("product"), "cycle", "eol")
    return cycles if as_of is None else past_cycles(cycles, as_of)


def deprecated_packages(meta: DataFrame) -> DataFrame:
    """(name, version): any non-empty notice, or true, deprecates a package."""
    d = X.utrim(F.coalesce("deprecated", F.lit("")))
    return meta.where(~d.isin("", "null", "false") & ~X.is_blank("version")).select("name", "version")


def read_package_deprecations(spark: SparkSession, path: str) -> DataFrame:
    return deprecated_packages(spark.read.schema(PACKAGE_META).option("multiLine", "true").json(path))


def breaking_entries(docs: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc, version, subsystem, subject, url) of SEMVER-MAJOR lines under their release heading.

    Documents are (doc, text).  The version is carried forward inside each document's own line
    array, so a document never becomes a sorted group.
    """
    lines = X.lines("text")
    blank = F.lit("").cast("string")
    start = F.struct(blank.alias("version"), F.array().cast("array<struct<version:string,line:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        heading = F.regexp_extract(line, RELEASE_HEADING, 1)
        entry = (acc["version"] != "") & F.contains(line, F.lit("(SEMVER-MAJOR)")) & (heading == "")
        return F.struct(
            F.when(heading != "", heading).otherwise(acc["version"]).alias("version"),
            F.when(
                entry, F.concat(acc["found"], F.array(F.struct(acc["version"].alias("version"), line.alias("line"))))
            ).otherwise(acc["found"]).alias("found"),
        )

    # Only headings and marked lines take part in the fold.
    relevant = F.filter(lines, lambda x: x.rlike(RELEASE_HEADING) | F.contains(x, F.lit("(SEMVER-MAJOR)")))
    found = docs.select("doc", F.explode(F.aggregate(relevant, start, step, lambda acc: acc["found"])).alias("f"))
    return _parsed_entries(found.select("doc", "f.version", "f.line"), cap)


def _parsed_entries(marked: DataFrame, cap: int | None) -> DataFrame:
    part = lambda i: F.regexp_extract("line", SEMVER_MAJOR, i)
    out = marked.where(F.col("line").rlike(SEMVER_MAJOR)).select(
        "doc", "version", part(1).alias("subsystem"), X.utrim(part(2)).alias("subject"), part(4).alias("url")
    )
    return out if cap is None else out.orderBy("version", "subsystem", "subject", "url", "doc").limit(cap)


def changelog_breaking(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """:func:`breaking_entries` of changelog files of any size, a folder or a pattern of them.

    Files are read by lines in ranges of bytes, as Spark splits them.  A line's version is the last heading of
    its own range or, before the first one there, that of the ranges before; only headings and marked lines
    are stored and sorted, and of a range only its last heading meets the other ranges.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("doc"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"),
        F.rtrim("value", F.lit("\r")).alias("line"),
    )
    heading = F.regexp_extract("line", RELEASE_HEADING, 1)
    told = lines.withColumn("heading", F.when(heading != "", heading))
    rows = cut_lineage(told.where(F.col("heading").isNotNull() | F.contains("line", F.lit("(SEMVER-MAJOR)"))))
    # Numbers of a range rise with its lines, as one task reads it.
    upto = Window.partitionBy("path", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("path", "start").agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("n"))).alias("end"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "start", F.last("end", ignorenulls=True).over(before).alias("carried"))
    held = rows.withColumn("own", F.last("heading", ignorenulls=True).over(upto)).join(carried, ["path", "start"])
    versions = held.where("heading IS NULL").select("doc", F.coalesce("own", "carried").alias("version"), "line")
    return _parsed_entries(versions.where("version IS NOT NULL"), cap)


def gotcha_sections(docs: DataFrame, prefix: str = "## ", cap: int | None = None) -> DataFrame:
    """(doc, title, snippet, explanation) of README sections with a code fence and an explanation.

    Only the part between the examples heading and the closing chapters counts; a repeated
    title keeps its last section.
    """
    text = F.regexp_replace("text", "\r\n", "\n")
    first = F.locate(EXAMPLES_START, text)
    body = F.when(first > 0, F.substr(text, first + F.lit(len(EXAMPLES_START)))).otherwise(text)
    for marker in EXAMPLES_END:
        body = F.substring_index(body, marker, 1)
    chunks = F.slice(F.split(F.concat(F.lit("\n"), body), "\n" + _quote(prefix)), 2, 1 << 30)
    sections = docs.select("doc", F.posexplode(chunks).alias("pos", "chunk")).select(
        "doc", "pos",
        X.utrim(F.substring_index("chunk", "\n", 1)).alias("title"),
        F.regexp_replace("chunk", r"^[^\n]*\n?", "").alias("section"),
    )
    titled = sections.where((F.col("title") != "") & ~F.col("title").isin(*SKIPPED_TITLES) & ~F.col("title").startswith("Section:"))
    last = titled.groupBy("doc", "title").agg(F.max_by("section", "pos").alias("section"))
    fences = F.filter(F.transform(F.regexp_extract_all("section", F.lit(CODE_FENCE), F.lit(1)), X.utrim), lambda c: c != "")
    snippet = F.coalesce(F.get(fences, F.lit(0)), F.lit("")) if prefix == "## " else F.array_join(fences, "\n\n")
    out = last.select(
        "doc", "title", snippet.alias("snippet"), X.utrim(F.regexp_extract("section", EXPLANATION[prefix], 1)).alias("explanation")
    ).where((F.col("snippet") != "") & (F.col("explanation") != ""))
    return out if cap is None else out.orderBy("title", "doc").limit(cap)


def _quote(literal: str) -> str:
    import re

    return re.escape(literal)


def readme_gotchas(spark: SparkSession, path: str, prefix: str = "## ", cap: int | None = None) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))
    return gotcha_sections(docs, prefix, cap)


def disallowed_sources(manifest: DataFrame, allowed: Sequence[str] = BACKGROUND_LICENSES) -> DataFrame:
    """Manifest rows (name, path, license) whose licence is not on the allowlist."""
    return manifest.where(~F.coalesce(F.col("license").isin(*allowed), F.lit(False)))


def read_background_corpus(spark: SparkSession, manifest: DataFrame, allowed: Sequence[str] = BACKGROUND_LICENSES) -> DataFrame:
    """(path, text): one document per file of the manifest's sources; binary files are skipped.

    Fails before reading anything when a source has a disallowed licence.
    """
    bad = [r["name"] for r in disallowed_sources(manifest, allowed).select("name").limit(20).collect()]
    if bad:
        raise ValueError(f"sources with a disallowed license: {', '.join(bad)}")
    # A manifest is a short hand-written list of folders; a reader takes paths, not a table of them.
    paths = [r["path"] for r in manifest.select("path").distinct().limit(MANIFEST_PATHS + 1).collect()]
    if len(paths) > MANIFEST_PATHS:
        raise ValueError(f"more than {MANIFEST_PATHS} paths in the manifest")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return text_files(files)


def text_files(files: DataFrame) -> DataFrame:
    """(path, text) of (path, content) rows without a NUL byte in the first 512 bytes."""
    head = F.substring("content", 1, 512)
    return files.where(F.locate("\0", F.decode(head, "ISO-8859-1")) == 0).select("path", F.decode("content", "UTF-8").alias("text"))
