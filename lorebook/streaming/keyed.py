"""A keyed table that micro-batches replace rows in, and that readers see in whole versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest

# Stored with every row: the batch that wrote it.
BATCH = "_batch"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by ``keys`` below ``root``: Parquet parts, one a batch, and manifests that name the parts that count.

    Every ``every`` parts are merged into one with the newest row of each key.  The last ``keep`` versions stay
    readable, so a reader that has opened one is not disturbed by merging.  One query writes a table.
    """

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    every: int = 20
    keep: int = 3

    def _versions(self) -> list[tuple[int, dict]]:
        return [(v, manifest.load(self.spark, self.root, v)) for v in manifest.versions(self.spark, self.root)]

    def _rows(self, parts: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in parts])

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Newest row per key, by a combinable aggregate."""
        rest = [c for c in rows.columns if c not in self.keys]
        picked = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("r"))
        return picked.select(*self.keys, "r.*")

    def snapshot(self, before: int | None = None) -> DataFrame | None:
        """The newest row per key as of the last version, or of the last one written by a batch before
        ``before``; None if there is none.  The result keeps to that version's files."""
        for _, content in reversed(self._versions()):
            if before is None or content["batch"] < before:
                return self._newest(self._rows(content["parts"])).drop(BATCH)
        return None

    def upsert(self, batch: DataFrame, batch_id: int, alive: Column | None = None) -> None:
        """Put a batch's rows, one per key, in place of the old ones.  A batch that is replayed changes nothing.
        Rows that are not ``alive`` may be forgotten; they go when parts are merged."""
        known = self._versions()
        content = known[-1][1] if known else {"batch": -1, "parts": []}
        if content["batch"] >= batch_id:
            return
        name = f"batch-{batch_id}-{uuid.uuid4().hex}"
        batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.parquet(f"{self.root}/data/{name}")
        parts = [*content["parts"], name]
        if len(parts) > self.every:
            merged = f"merged-{batch_id}-{uuid.uuid4().hex}"
            rows = self._newest(self._rows(parts))
            (rows if alive is None else rows.where(alive)).write.parquet(f"{self.root}/data/{merged}")
            parts = [merged]
        manifest.publish(self.spark, self.root, {"batch": batch_id, "parts": parts})
        self._vacuum([*known, (0, {"parts": parts})])

    def _vacuum(self, known: list[tuple[int, dict]]) -> None:
        """Forget all but the last ``keep`` versions, and what none of these names."""
        old = known[: -self.keep]
        if not old:
            return
        named = {p for _, content in known[-self.keep :] for p in content["parts"]}
        for version, _ in old:
            manifest.forget(self.spark, self.root, version)
        loose = [p for p in manifest.folders(self.spark, f"{self.root}/data") if p not in named]
        manifest.remove(self.spark, *[f"{self.root}/data/{p}" for p in loose])
