"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

A text is read as its overlapping character 4-grams, each written as 8 hashed bytes: a match in
a dictionary then always pays, where plain matches of four or five letters cost zstandard as much
as the letters.  One dictionary is trained on ordinary text, first on its windows and then on
those of its words that the first part compresses badly.  The other one holds the same and a
small part trained on words of toxic text that the ordinary dictionary compresses badly.  A window
is compressed with both; the bytes that the toxic dictionary saves are its distance.  A document's
score comes from its windows' distances, weighed on labelled documents that neither dictionary
has seen.

The model is trained on a bounded sample (``Bounds``); all documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, few_rows

GRAM = 4
# 4-grams in a window, and bytes of each.
WINDOW, WIDE = 64, 8
LEVEL = 6
HELD_OUT = 5


@dataclass(frozen=True)
class Bounds:
    """What may be read for training: documents of either class, characters of each, samples of
    a dictionary; and the dictionaries' sizes in bytes."""

    toxic: int = 1_600
    ordinary: int = 3_200
    characters: int = 12_000
    word_samples: int = 400_000
    ordinary_bytes: int = 1 << 19
    hard_bytes: int = 1 << 18
    toxic_bytes: int = 1 << 12


def widen(text: str) -> np.ndarray:
    """A hash of each overlapping 4-gram of the lower-cased bytes between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64)
    n = len(b) - GRAM + 1
    x = sum((b[i : n + i] << np.uint64(8 * i) for i in range(GRAM)), np.zeros(n, np.uint64)) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(text: str) -> Iterator[bytes]:
    wide = widen(text).tobytes()
    step = WINDOW * WIDE
    return (wide[i : i + step] for i in range(0, max(1, len(wide)), step))


def _word_samples(texts: list[str], limit: int) -> list[bytes]:
    words = (w for t in texts for w in t.split() if len(w) >= GRAM - 1)
    return [widen(w).tobytes() for w in islice(words, limit)]


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; of too few samples for that, the samples themselves."""
    try:
        return zstandard.train_dictionary(size + 512, samples, k=segment, d=WIDE).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """Two dictionaries, the distance from which a window counts, and the weights of a score."""

    ordinary: bytes = b""
    extra: bytes = b""
    threshold: float = 0.0
    weights: list[float] = field(default_factory=list)

    def open(self) -> None:
        self._plain, self._toxic = _compressor(self.ordinary), _compressor(self.extra + self.ordinary)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def distances(self, text: str) -> np.ndarray:
        plain, toxic = self._plain.compress, self._toxic.compress
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)

    def features(self, text: str) -> np.ndarray:
        """1, the largest and the second largest distance, their mean, and the share of windows
        at the threshold or above; each is kept within bounds so that none outweighs the rest."""
        d = np.sort(self.distances(text))[::-1]
        second = d[1] if len(d) > 1 else 0.0
        return np.array([1.0, min(d[0], 40) / 10, min(second, 40) / 10, min(max(d.mean(), -4), 8), (d >= self.threshold).mean() * 4])

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = float(self.features(text or "") @ np.array(self.weights))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def fit(rows: list[tuple[str, int]], bounds: Bounds = Bounds()) -> Model:
    """A model from (text, toxic) rows; every fourth of a class is left for the calibration.
    Without rows of both classes all scores are 0."""
    by = {k: [t for t, x in rows if x == k] for k in (0, 1)}
    if not by[0] or not by[1]:
        return Model()
    train = {k: [t for i, t in enumerate(v) if i % 4 or len(v) < 8] for k, v in by.items()}
    first = _dictionary([w for t in train[0] for w in windows(t)], bounds.ordinary_bytes, 64)
    costly = lambda model, words: [w for w in words if len(model.compress(w)) >= 3 * WIDE]
    words = _word_samples(train[0], bounds.word_samples)
    plain = _dictionary(costly(_compressor(first), words), bounds.hard_bytes, 32) + first
    words = _word_samples(train[1], bounds.word_samples)
    model = Model(plain, _dictionary(costly(_compressor(plain), words), bounds.toxic_bytes, 24))
    model.open()
    held = [(t, k) for k, v in by.items() for i, t in enumerate(v) if not i % 4 or len(v) < 8]
    seen = np.concatenate([model.distances(t) for t, k in held if k == 0])
    model.threshold = float(max(4.0, np.quantile(seen, 0.998)))
    x, y = np.array([model.features(t) for t, _ in held]), np.array([k for _, k in held], float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0, *[0.02] * (x.shape[1] - 1)])
    for _ in range(40):  # Newton's steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge @ w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    model.weights = w.tolist()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on at most ``bounds.toxic`` and ``bounds.ordinary`` labelled documents, chosen by the
    hash of their id; only these, at most ``bounds.characters`` of each, reach the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = None
    for value, most in ((1, bounds.toxic), (0, bounds.ordinary)):
        part = known.where(F.col("_toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    sample = (
        docs.select("doc_id", F.substring("text", 1, bounds.characters).alias("_text"))
        .where("_text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
    )
    return fit([(r["_text"], int(r["_toxic"])) for r in sample.select("_text", "_toxic").collect()], bounds)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null texts score as empty ones.  Repeated texts score alike.  Empty input: empty result.
    Other columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for b in few_rows(batches):
            score = pa.array([model.score(t.as_py()) for t in b.column(2)], pa.float64())
            yield pa.record_batch([b.column(0), b.column(1), score], ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(scored, "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for b in few_rows(batches):
            texts = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([model.score(t.as_py()) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
