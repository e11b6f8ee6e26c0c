"""Version strings as orderable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, utrim


def version_key(v) -> Column:
    """An orderable key: numeric parts without trailing zeros, then release after pre-release.

    Build metadata is ignored and parsing stops at the first non-numeric part.
    """
    core = F.substring_index(F.regexp_replace(utrim(v), "^v", ""), "+", 1)
    is_release = (F.instr(core, "-") == 0).cast("int")
    numeric = F.regexp_extract(F.substring_index(core, "-", 1), r"^([0-9]{1,18}(?:\.[0-9]{1,18})*)(?=\.|\z)", 1)
    trimmed = F.regexp_replace(numeric, r"(?:^|\.)0+(?:\.0+)*\z", "")
    parts = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.split(trimmed, r"\.").cast("array<bigint>"))
    return F.struct(parts.alias("parts"), is_release.alias("release"))


def in_affected_range(version, introduced, fixed) -> Column:
    """introduced <= version < fixed, where a null or empty bound is open."""
    key = version_key(version)
    introduced, fixed = col(introduced), col(fixed)
    lower = (F.coalesce(introduced, F.lit("")) == "") | (key >= version_key(introduced))
    upper = (F.coalesce(fixed, F.lit("")) == "") | (key < version_key(fixed))
    return lower & upper


def major_minor(v) -> Column:
    """'2.15.0' -> '2.15', '18' -> '18'; null without a leading number."""
    return F.nullif(F.regexp_extract(utrim(v), r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
