"""The record corpus: markdown files with front matter, and writing changed snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions import text as X
from ..operators.records import RE_PATH, violations_column
from ..schemas import RECORD
from ..session import cut_lineage

FENCE = "---\n"


def _coerce(value, dtype):
    """A YAML value, its scalars as written, as the given Spark type; None where it does not fit."""
    if value is None:
        return None
    if isinstance(dtype, StructType):
        if not isinstance(value, dict):
            return None
        return {f.name: _coerce(value.get(f.name), f.dataType) for f in dtype.fields}
    if isinstance(dtype, ArrayType):
        return [_coerce(v, dtype.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(dtype, MapType):
        return {str(k): _coerce(v, dtype.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if not isinstance(value, str):
        return None
    if dtype.typeName() in ("integer", "long"):
        return int(value) if re.fullmatch(r"[-+]?[0-9]+", value) else None
    if dtype.typeName() == "boolean":
        return {"true": True, "false": False}.get(value.lower())
    return value


def _unknown(value, dtype, path=""):
    """First front-matter key that the schema does not know."""
    if isinstance(dtype, StructType) and isinstance(value, dict):
        names = {f.name: f.dataType for f in dtype.fields}
        for key, v in value.items():
            if key not in names:
                return f"{path}{key}"
            found = _unknown(v, names[key], f"{path}{key}.")
            if found:
                return found
    if isinstance(dtype, ArrayType) and isinstance(value, list):
        for v in value:
            found = _unknown(v, dtype.elementType, path)
            if found:
                return found
    return None


def _decode_front_matter(schema: StructType):
    """Arrow-batch decoder: YAML front matter -> JSON text of the record, or a reason."""

    def decode(batches):
        import json

        import yaml

        # Scalars keep their written text ('1.10', 'on', '0123'); only a plain null has a type.
        class Written(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            yaml_implicit_resolvers = {
                start: [r for r in rules if r[0] in ("tag:yaml.org,2002:null", "tag:yaml.org,2002:merge")]
                for start, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
            }

        for batch in batches:
            out, reasons, unknown = [], [], []
            for front in batch["front"]:
                doc, reason, extra = None, None, None
                if front is not None:
                    try:
                        raw = yaml.load(front, Loader=Written)
                        if isinstance(raw, dict):
                            extra = _unknown(raw, schema)
                            doc = json.dumps(_coerce(raw, schema))
                        else:
                            reason = "front matter is not a mapping"
                    except yaml.YAMLError:
                        reason = "front matter is not valid YAML"
                out.append(doc)
                reasons.append(reason)
                unknown.append(extra)
            yield batch.drop(columns=["front"]).assign(doc=out, yaml_error=reasons, unknown_key=unknown)

    return decode


def read_corpus(
    spark: SparkSession, path: str, mode: str = "strict", now: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of every ``experience/YYYY/NNNN-slug.md`` below ``path``.

    strict     unknown keys, bad rows, duplicate ids and dangling links are rejected
    resilient  like strict, but the first path of a duplicate id is kept
    serve      unknown keys are ignored as well
    rejects is (path, reason, critical); an unsupported schema version is critical.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parse_corpus(files.select(F.col("_metadata.file_path").alias("path"), "value"), mode, now)


def parse_corpus(files: DataFrame, mode: str = "strict", now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`read_corpus` over a table of (path, value) files."""
    if mode not in ("strict", "resilient", "serve"):
        raise ValueError(f"unknown corpus mode {mode!r}")
    files = files.select("value", F.regexp_extract("path", r"(experience/[0-9]{4}/[^/]+)$", 1).alias("path")).where(F.col("path").rlike(RE_PATH))
    src = F.col("value")
    rest = F.substring(src, len(FENCE) + 1, 1 << 30)
    end = F.instr(rest, "\n---\n")
    body = X.utrim(F.expr(f"substring(substring(value, {len(FENCE) + 1}), instr(substring(value, {len(FENCE) + 1}), '\\n---\\n') + 5)"))
    parts = files.select(
        "path",
        F.when(~src.startswith(FENCE), "missing leading front matter fence")
        .when(end == 0, "unterminated front matter fence")
        .when(body == "", "narrative body must be non-empty")
        .alias("fence_error"),
        F.when(
            src.startswith(FENCE) & (end > 0),
            F.expr(f"substring(substring(value, {len(FENCE) + 1}), 1, instr(substring(value, {len(FENCE) + 1}), '\\n---\\n'))"),
        ).alias("front"),
        body.alias("body"),
    )
    stored = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(RECORD).fields if f.name not in ("body", "path")
    )
    decoded = parts.mapInPandas(
        _decode_front_matter(StructType.fromDDL(stored)), "path string, fence_error string, body string, doc string, yaml_error string, unknown_key string"
    )
    parsed = decoded.withColumn("r", F.from_json("doc", stored)).select("path", "fence_error", "yaml_error", "unknown_key", "r.*", "body")
    columns = [f.name for f in StructType.fromDDL(RECORD).fields]
    today = F.current_date().cast("string") if now is None else F.lit(now)
    rules = violations_column(today if now is None else now)
    unknown = F.when(F.lit(mode != "serve") & F.col("unknown_key").isNotNull(), F.concat(F.lit("unknown key "), "unknown_key"))
    checked = parsed.withColumn("rules", rules).withColumn(
        "reason",
        F.coalesce(
            "fence_error", "yaml_error", unknown,
            F.when(F.size("rules") > 0, F.concat(F.lit("invalid: "), F.array_join("rules", ", "))),
        ),
    )
    # Front matter is decoded by Python workers: decode once, reuse for both outputs.
    checked = cut_lineage(checked)
    critical = F.array_contains("rules", "schema_version") & F.coalesce("fence_error", "yaml_error").isNull()
    rejects = checked.where(F.col("reason").isNotNull()).select("path", "reason", critical.alias("critical"))
    good = checked.where(F.col("reason").isNull()).select(*columns)
    first = good.groupBy("id").agg(F.min("path").alias("_first"), F.count("*").alias("_n"))
    tagged = good.join(first, "id")
    duplicates = tagged.where(F.col("path") != F.col("_first")).select(
        "path", F.concat(F.lit("duplicate id "), "id", F.lit(" (already loaded from "), "_first", F.lit(")")).alias("reason"),
        F.lit(False).alias("critical"),
    )
    rejects = rejects.unionByName(duplicates)
    records = tagged.where(F.col("path") == F.col("_first")).select(*columns)
    if mode == "strict":
        ids = good.select(F.col("id").alias("target")).distinct()
        dangling = good.select("path", F.col("provenance.superseded_by").alias("target")).where(F.col("target").isNotNull()).join(
            ids, "target", "left_anti"
        )
        rejects = rejects.unionByName(
            dangling.select("path", F.concat(F.lit("superseded_by "), "target", F.lit(" does not exist")).alias("reason"), F.lit(False).alias("critical"))
        )
        records = records.join(dangling.select("path"), "path", "left_anti").select(*columns)
    return records, rejects


def changed_records(new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` that are absent from ``old`` or differ from it (null-safe, all columns)."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in new.columns]), {"ignoreNullFields": "false"}), 256)
    a = new.withColumn("_d", digest)
    b = old.select(*new.columns).select(key, digest.alias("_o"))
    return a.join(b, key, "left").where(F.col("_o").isNull() | (F.col("_o") != F.col("_d"))).select(*new.columns)


def write_records(new: DataFrame, old: DataFrame, path: str, key: str = "id") -> int:
    """Write the merged snapshot to a new ``path`` and return how many records changed.

    The snapshot holds every new record and the old ones without a successor.
    """
    changed = changed_records(new, old, key).count()
    kept = old.select(*new.columns).join(new.select(key), key, "left_anti")
    new.unionByName(kept).write.mode("errorifexists").parquet(path)
    return changed


def flush_usage(records: DataFrame, usage: DataFrame) -> DataFrame:
    """(records whose stored usage differs from the counters), with the counters stamped in."""
    u = usage.select(
        F.col("record_id").alias("id"),
        F.struct("retrieved", "pushed", "confirmed_helpful", F.col("last_hit").cast("string").alias("last_hit")).alias("_u"),
    )
    old, new = F.col("provenance.usage"), F.col("_u")
    differs = ~old["retrieved"].eqNullSafe(new["retrieved"])
    for name in ("pushed", "confirmed_helpful", "last_hit"):
        differs = differs | ~old[name].eqNullSafe(new[name])
    return (
        records.join(u, "id").where(old.isNull() | differs)
        .withColumn("provenance", F.col("provenance").withField("usage", F.col("_u")))
        .select(*records.columns)
    )
