"""Session construction and the few helpers that depend on cluster settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Spark's own switch: remove a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Lists of the tables stored by this thread inside :func:`settled`, innermost last.
_scopes = threading.local()


def build_session(app: str = "lorebook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  Where none is set, a local session gets one of its own;
    on a cluster the executors would not share it, so the setting is required."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="lorebook-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that losing an executor never replays
    its inputs.  The files' sizes in bytes then decide which side of a join is broadcast.  The
    shuffle files behind it have served their purpose and are removed at once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    for tables in getattr(_scopes, "open", []):
        tables.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make``, stored; the tables that ``make`` has stored on the way are removed."""
    tables: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), tables]
    try:
        df = make()
    finally:
        _scopes.open = [t for t in _scopes.open if t is not tables]
    out = cut_lineage(df)
    path = out.sparkSession._jvm.org.apache.hadoop.fs.Path
    for table in tables:
        at = path(table)
        at.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        for outer in _scopes.open:
            if table in outer:
                outer.remove(table)
    return out
