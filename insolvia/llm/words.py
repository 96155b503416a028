"""Batch helpers shared by the text operators: Arrow chunks, byte-level words, vectorised hashes.

All of them work on UTF-8 bytes. A word is a maximal run of "word" bytes inside one text; the two
word definitions in use differ only in which ASCII bytes separate words, so both are byte tables.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are worked on in chunks of about this many bytes, whatever the Arrow batch holds;
# a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

# A null document id takes part as an id after all others.
LAST_ID = (1 << 63) - 1

WHITE = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

#: bytes.translate tables: A-Z lowered; and the same with every byte that is in no alphanumeric word made a space.
LOWERED = bytes.maketrans(UPPER, LOWER)
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITE)] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWER_BASE = 0xD6E8FEB86659FD93


def row_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def shown_id(column: Column) -> Column:
    return F.when(column != F.lit(LAST_ID), column)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunked(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by a space, and where each starts (one more entry: the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every white-space separated word, and the first word of each text."""
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, bounds)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int = _POWER_BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            grow = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


_POWERS = Powers()
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[data] * up[: len(data)])])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; entry i covers words i .. i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD + words[j : j + n]
    return mixed(out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the intervals [start, start + size), one interval after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return shift + np.arange(len(shift))
