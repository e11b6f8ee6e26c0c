"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The vocabulary file is read once per task from the path given.  Pre-tokens are encoded one by
one; short ones are remembered in a bounded table per worker, as the same words come again and
again.  Long ones cost O(n log n), whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, few_rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Pre-tokens of at most this many bytes are remembered, this many at a time per worker.
SHORT = 32
REMEMBERED = 1_000_000
# White space as Unicode's property has it; Python's own class has four separators more.
_SPACES = r"\p{White_Space}"


def pattern(source: str = public_tokenizers.PATTERN) -> regex.Pattern:
    inside = source.replace(r"[^\s", "[^" + _SPACES).replace(r"\S", "[^" + _SPACES + "]")
    return regex.compile(inside.replace(r"\s", _SPACES))


class RankQueue:
    """Places waiting for a merge, by rank.

    Each rank has a bucket: one place, or a heap of several.  Three levels of 64-bit words mark
    the ranks whose buckets hold something; find-first-set on each level gives the least rank.
    An emptied queue has all words at zero, so one queue serves one pre-token after another.
    """

    __slots__ = ("top", "middle", "bottom", "buckets")

    def __init__(self, ranks: int) -> None:
        self.top = 0
        self.middle = [0] * ((ranks >> 12) + 1)
        self.bottom = [0] * ((ranks >> 6) + 1)
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = place
            a = rank >> 6
            word = self.bottom[a]
            self.bottom[a] = word | 1 << (rank & 63)
            if not word:
                b = rank >> 12
                self.middle[b] |= 1 << (a & 63)
                self.top |= 1 << b
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, place] if bucket < place else [place, bucket]
        else:
            heappush(bucket, place)

    def pop(self) -> tuple[int, int]:
        """The least rank and its least place; only while ``top`` is not zero."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.middle[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.bottom[a]
        low = word & -word
        rank = a << 6 | low.bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is not int:
            place = heappop(bucket)
            if bucket:
                return rank, place
            bucket = place
        del self.buckets[rank]
        word ^= low
        self.bottom[a] = word
        if not word:
            self.middle[b] ^= 1 << (a & 63)
            if not self.middle[b]:
                self.top ^= 1 << b
        return rank, bucket


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token.

    Places form a linked list.  The lowest-ranked pair, leftmost first, is merged; a queued
    place is stale if it went or its pair has another rank by now, and is skipped.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # Long pre-tokens take eight bytes a place instead of an object.
    row = list if n < 4096 else lambda x: array("q", x)
    after, before, wanted = row(range(1, n + 2)), row(range(-1, n)), row([-1]) * (n + 1)
    get, push, pop = ranks.get, queue.push, queue.pop
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            wanted[i] = r
            push(r, i)
    while queue.top:
        rank, i = pop()
        if wanted[i] != rank:
            continue
        gone = after[i]
        wanted[gone] = -1
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            if r is None:
                wanted[i] = -1
            else:
                wanted[i] = r
                push(r, i)
        else:
            wanted[i] = -1
        left = before[i]
        if left >= 0:
            r = get(piece[left:end])
            if r is None:
                wanted[left] = -1
            elif wanted[left] != r:
                wanted[left] = r
                push(r, left)
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


class Codec:
    """Encodes and decodes with one vocabulary of (bytes, rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.split = pattern().findall
        self.queue = RankQueue(len(self.pieces))
        self.known: dict[str, bytes] = {}

    def _ids(self, token: str) -> bytes:
        piece = token.encode()
        ids = merge(piece, self.ranks, self.queue)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        known, ids = self.known.get, self._ids
        return b"".join([known(t) or ids(t) for t in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids]) for every row of ``docs`` (doc_id, text).

    ``path`` names the vocabulary on every executor.  A null text is encoded as the empty one
    (no tokens).  Repeated rows and ids give repeated results; empty input an empty one.  Other
    columns are not read.  ``with_ids`` adds the token ids themselves.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = codec(path), hashlib.sha256
        for b in few_rows(batches):
            ids = [coder.encode(t.as_py() or "") for t in b.column(1)]
            columns = [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([sha(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha(coder.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
