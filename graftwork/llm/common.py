"""Helpers shared by the training-data operators: storage, words, hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize  # noqa: F401

#: A word cache is emptied beyond this many entries, so a worker's memory stays bounded.
CACHE_ENTRIES = 400_000
#: Longer words are hashed each time instead of being kept.
CACHE_WORD_BYTES = 32
U64 = np.uint64
#: Rows that go to a Python worker at a time. Spark's own default, 10,000, is tens of megabytes of documents.
BATCH_ROWS = 1000


#: A table of at most so many bytes is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session's Arrow batches are made smaller, unless the user has set their size, to whatever."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(key):
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def broadcast_if_small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A stored table, to be broadcast if its rows, of ``row_bytes`` each, add up to BROADCAST_BYTES at most; else as it is."""
    size = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def column_of(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; strings as their UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()


def _give_back() -> None:
    """What a worker has freed goes back to the machine, so workers that are used again don't grow from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = 8 << 20):
    """Parts of a batch with about ``most`` bytes of text each, so that arrays made from them stay small."""
    col = batch.column(batch.schema.get_field_index(text))
    size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    _give_back()


class WordHash(dict):
    """word bytes -> 64-bit hash, the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


_words = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six characters."""
    return text.split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word (splitmix64's constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_MULT = 0x9E3779B97F4A7C15 | 1


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    out = np.zeros(m, U64)
    mult = U64(_MULT)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= mult
            out += h[k : k + m]
        return mix64(out)
