"""Numbered manifests: the one thing that is replaced in a table of immutable files.

A version is a folder ``manifest-<number>`` that counts once its ``_SUCCESS`` mark is there, which a file
system or object store shows last.  Nothing is renamed.  Readers load a version and keep to the files it
names; a version is written once, and a second writer of the same number fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), path, at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole manifests below ``root``, ascending."""
    fs, path, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("manifest-")]
    return sorted(int(p.getName().removeprefix("manifest-")) for p in found if fs.exists(path(p, "_SUCCESS")))


def _at(root: str, version: int) -> str:
    return f"{root}/manifest-{version:08d}"


def load(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(_at(root, version), wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, content: dict) -> int:
    """Write the next version and return its number."""
    known = versions(spark, root)
    version = (known[-1] if known else 0) + 1
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(_at(root, version))
    return version


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders that no kept version names."""
    for p in paths:
        fs, _, at = _fs(spark, p)
        fs.delete(at, True)


def forget(spark: SparkSession, root: str, version: int) -> None:
    remove(spark, _at(root, version))


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of what lies directly below ``root``."""
    fs, _, at = _fs(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
