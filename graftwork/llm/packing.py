"""Vector bin packing of tokenised examples into training sequences.

Each example is a vector (tokens, 1 segment, loss-bearing tokens). A sequence is a bin with a limit in each
dimension. What fills whole sequences by itself is cut off first. The rest waits in a bounded pool; a bin
takes, again and again, the waiting piece with the largest dot product between the piece and what is left
in the bin, each dimension divided by its limit and weighted by the pool's demand. If no piece fits, or
one segment is left, the longest piece is cut to fill the bin. A bin that stays below a power of two, which
only the last of a task or one out of segments does, is laid out as sequences of power-of-two lengths, so
nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, small_batches
from .tokens import encoder

#: Pieces that wait in a task at most; half of them are packed when the pool is full.
POOL = 1024
_INTS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


class Packer:
    """Packs the examples of one task; ``rows`` has the pieces that are placed."""

    def __init__(self, first: int, max_tokens: int, max_segments: int, max_loss: int, with_ids: bool) -> None:
        self.next, self.limit, self.with_ids = first, np.array([max_tokens, max_segments, max_loss], np.float64), with_ids
        self.t, self.s, self.loss = max_tokens, max_segments, max_loss
        self.tok, self.free = np.zeros(POOL, np.int64), np.zeros(POOL, np.int64)  # tokens left; of these, first ones without loss
        self.what: list = [None] * POOL
        self.n = 0
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, free: int) -> None:
        """ids: all of an example; its first ``free`` bear no loss."""
        total, start = len(ids), 0
        while total - start >= self.t and self.t - max(0, min(self.t, free - start)) <= self.loss:
            self._put([(key, ids, start, self.t, free)])
            start += self.t
        if start < total:
            if self.n == POOL:
                self.drain(POOL // 2)
            self.tok[self.n], self.free[self.n], self.what[self.n] = total - start, max(0, free - start), (key, ids, start, free)
            self.n += 1

    def drain(self, left: int = 0) -> None:
        while self.n > left:
            self._bin()

    def _take(self, i: int, n: int) -> tuple:
        key, ids, start, free = self.what[i]
        if n == self.tok[i]:
            self.n -= 1
            for x in (self.tok, self.free, self.what):
                x[i] = x[self.n]
            self.what[self.n] = None
        else:
            self.what[i] = key, ids, start + n, free
            self.tok[i] -= n
            self.free[i] = max(0, self.free[i] - n)
        return key, ids, start, n, free

    def _bin(self) -> None:
        room, bin_ = np.array([self.t, self.s, self.loss], np.float64), []
        tok, loss = self.tok[: self.n], np.maximum(0, self.tok[: self.n] - self.free[: self.n])
        weight = np.array([tok.sum(), self.n, loss.sum()]) / self.limit
        weight /= max(weight.sum(), 1e-9)
        while self.n and room[0] and room[1]:
            tok = self.tok[: self.n]
            loss = np.maximum(0, tok - self.free[: self.n])
            w = weight * room / self.limit**2
            score = np.where((tok <= room[0]) & (loss <= room[2]), w[0] * tok + w[1] + w[2] * loss, -1.0)
            i = int(score.argmax())
            n = int(tok[i])
            if score[i] < 0 or room[1] == 1:
                i = int(tok.argmax())
                n = int(min(tok[i], room[0], self.free[i] + room[2]))
            if n == 0:
                i = int(self.free[: self.n].argmax())
                n = int(min(tok[i], room[0], self.free[i]))
                if n == 0:
                    break
            bears = max(0, n - int(self.free[i]))
            bin_.append(self._take(i, n))
            room -= (n, 1, bears)
        self._put(bin_)

    def _put(self, pieces: list[tuple]) -> None:
        total, k, at = sum(p[3] for p in pieces), 0, 0
        while total:
            size = self.t if total == self.t else 1 << (total.bit_length() - 1)
            total -= size
            offset = 0
            while offset < size:
                key, ids, start, n, free = pieces[k]
                m = min(n - at, size - offset)
                data = ids[start + at : start + at + m].tobytes()
                a = start + at
                self.rows.append((key, a, m, zlib.crc32(data), len(ids), self.next, offset, m - max(0, min(m, free - a)), data if self.with_ids else None))
                offset, at = offset + m, at + m
                if at == n:
                    k, at = k + 1, 0
            self.next += 1


def pack(df: DataFrame, tokenizer: str, max_tokens: int = 1024, max_segments: int = 64, max_loss_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Packs every row's prompt (no loss) and text (loss), each encoded, and ``end_id`` (loss), into sequences.

    Returns a row for each piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset in the sequence, loss_tokens, ids (little-endian unsigned 32-bit; null without ``with_ids``).
    A null or empty text is the end id alone. Null ids stay null, repeated rows are packed each, other columns are
    ignored, an empty table gives an empty result. Sequence ids are made of the partition's number and a counter:
    no shuffle, and a task that is run again gives the same pieces as long as its input has a fixed order (a scan
    or a checkpoint). A task keeps one batch and ``POOL`` pieces in memory.
    """
    if min(max_tokens, max_segments, max_loss_tokens) < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("limits must be positive, and max_tokens a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        packer = Packer(TaskContext.get().partitionId() << 33, max_tokens, max_segments, max_loss_tokens, with_ids)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:8]), pa.array(cols[8], pa.binary())], ["doc_id", *_INTS, "ids"])

        key_type = None
        for whole in batches:
            key_type = whole.schema.field(0).type
            for batch in slices(whole, "text"):
                prompts = column_of(batch, "prompt")
                for key, text, prompt in zip(batch.column(0).to_pylist(), column_of(batch, "text"), prompts, strict=True):
                    head = enc.ids(prompt.decode()) if prompt else end[:0]
                    packer.add(key, np.concatenate([head, enc.ids((text or b"").decode()), end]).astype("<u4"), len(head))
                yield out()
        if key_type is not None:
            packer.drain()
            yield out()

    chosen = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), (df[prompt_col] if prompt_col else F.lit(None)).cast("string").alias("prompt"))
    return small_batches(chosen).mapInArrow(run, f"doc_id {chosen.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _INTS) + ", ids binary")
