"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 4-grams of a text's characters, lower-cased and with everything that isn't a letter as a single
space, hashed into ``buckets``. Counts of every labelled document are added up per language and bucket; the matrix of
log-probabilities, languages x buckets, is broadcast: its size is bounded by TOGETHER x buckets x 4 bytes, as more languages are
scored in several passes. Texts are scored in numpy, a batch at a time: a gather of log-probabilities for each n-gram that
occurs and a sum per document; n-grams are made BLOCK characters at a time, so a long document isn't held as arrays of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, slices, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Languages whose log-probabilities go to all tasks at a time.
TOGETHER = 256
#: Characters whose n-grams are made at a time.
BLOCK = 1 << 17
UND = "und"
_SPACE = np.uint32(32)


def _letter_table() -> np.ndarray:
    """code point -> its lower-case letter, or a space for what is no letter (Basic Multilingual Plane)."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in map(chr, range(0x10000))]
    return np.array([ord(c) for c in low], np.uint32)


_letters: np.ndarray | None = None


def _fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, others as spaces, the document of each, and which documents have letters.

    Runs of non-letters are one space, within a document.
    """
    global _letters
    if _letters is None:
        _letters = _letter_table()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.array([len(x) for x in texts], np.int64))
    if len(code) and code.max() > 0xFFFF:
        high = code > 0xFFFF
        folded = _letters[np.where(high, 32, code)]
        at = np.flatnonzero(high)
        folded[at] = [ord(c) if (c := chr(x)).isalpha() else 32 for x in code[at].tolist()]
    else:
        folded = _letters[code]
    has = np.zeros(len(texts), bool)
    has[doc[folded != _SPACE]] = True
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != _SPACE) | (folded[:-1] != _SPACE) | (doc[1:] != doc[:-1])
    return folded[keep], doc[keep], has


def _grams(folded: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams and the document of each, a block of first letters at a time; none has parts of two documents."""
    for a in range(0, len(folded), BLOCK):
        b = min(len(folded), a + BLOCK)
        part = folded[a : b + max(ORDERS) - 1].astype(U64)
        own = doc[a : b + max(ORDERS) - 1]
        h, out, of = np.zeros(b - a, U64), [], []
        with np.errstate(over="ignore"):
            for n in range(1, max(ORDERS) + 1):
                m = min(b - a, len(part) - n + 1)
                if m <= 0:
                    break
                h = h[:m] * U64(0x9E3779B97F4A7C15) + part[n - 1 : n - 1 + m] + U64(n)
                if n in ORDERS:
                    same = own[:m] == own[n - 1 : n - 1 + m]
                    x = h ^ (h >> U64(29))
                    x = (x * U64(0xBF58476D1CE4E5B9)) >> U64(40)
                    out.append((x[same] % U64(buckets)).astype(np.int32))
                    of.append(own[:m][same])
        yield np.concatenate(out), np.concatenate(of)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(text, lang) -> languages in order, and their log-probabilities [language, bucket], the prior in a last column.

    Counts every row with a text and a language, on the driver as languages x (buckets + 1) numbers. Laplace smoothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
                ids = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                of_doc = np.array([ids[x] for x in langs], np.int64)
                got = np.zeros(len(ids) * (buckets + 1), np.int64)
                folded, doc, _ = _fold(_texts(batch))
                for bucket, doc_ in _grams(folded, doc, buckets):
                    got += np.bincount(of_doc[doc_] * (buckets + 1) + bucket, minlength=len(got))
                got = got.reshape(len(ids), buckets + 1)
                got[:, buckets] += np.bincount(of_doc, minlength=len(ids))
                for lang, i in ids.items():
                    sums[lang] = sums[lang] + got[i] if lang in sums else got[i]
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["lang", "bucket", "n"])

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = small_batches(rows).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    names = sorted(table["lang"].unique().to_pylist())
    counts = np.zeros((len(names), buckets + 1))
    row = np.searchsorted(np.array(names, object), np.array(table["lang"].to_pylist(), object)) if names else np.empty(0, np.int64)
    counts[row, table["bucket"].to_numpy()] = table["n"].to_numpy()
    log = np.log(counts + 1.0)
    if len(names):
        log[:, :buckets] -= np.log((counts[:, :buckets] + 1).sum(1, keepdims=True))
        log[:, buckets] -= np.log((counts[:, buckets] + 1).sum())
    return names, log.astype(np.float32)


def _pass(chosen: DataFrame, log: np.ndarray, first: int) -> DataFrame:
    """``chosen`` (..., text, best, top, total) after a look at some more languages, numbered from ``first``: the best one
    so far, its log-probability, and the logarithm of the sum of all probabilities. best is -1 for a text without letters."""
    shared = chosen.sparkSession.sparkContext.broadcast(log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n = batch.num_rows
                folded, doc, has = _fold(_texts(batch))
                score = np.repeat(log[:, -1:].astype(np.float64), n, axis=1)
                for bucket, doc_ in _grams(folded, doc, log.shape[1] - 1):
                    score += np.stack([np.bincount(doc_, row[bucket], n) for row in log])
                best, top, total = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 3, batch.num_columns))
                own, at = score.max(0), score.argmax(0) + first
                better = own > top
                with np.errstate(over="ignore", divide="ignore"):
                    total = np.logaddexp(total, own + np.log(np.exp(score - own).sum(0)))
                new = [pa.array(np.where(has, np.where(better, at, best), -1), pa.int64()), pa.array(np.where(better, own, top)), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], batch.schema.names)

    return small_batches(chosen).mapInArrow(run, chosen.schema)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred, score (the posterior probability of lang_pred).

    A text that is null or has no letters, and any text if nothing was learned, is ``und`` with score 0. Ties go to the
    first language in order. Null ids stay null, repeated rows each give a row, other columns are ignored, empty tables
    give empty results.
    """
    names, log = model
    nothing = [F.lit(-1).cast("long").alias("best_so_far"), F.lit(float("-inf")).alias("top_so_far"), F.lit(float("-inf")).alias("total_so_far")]
    rows = df.select(df[id_col].alias("doc_id"), *keep, df[text_col].cast("string").alias("text"), *nothing)
    for k in range(0, len(names), TOGETHER):
        rows = _pass(materialize(rows, "languages") if k else rows, log[k : k + TOGETHER], k)
    known = F.array(*map(F.lit, names)) if len(names) <= TOGETHER else F.lit(None).cast("array<string>")
    name = F.get(known, F.col("best_so_far").cast("int"))
    if len(names) > TOGETHER:
        table = df.sparkSession.createDataFrame(list(enumerate(names)), "n long, lang_name string")
        rows, name = rows.join(table, F.col("best_so_far") == F.col("n"), "left"), F.col("lang_name")
    found = F.col("best_so_far") >= 0
    score = F.when(found, F.least(F.lit(1.0), F.exp(F.col("top_so_far") - F.col("total_so_far")))).otherwise(0.0)
    return rows.select("doc_id", *rows.columns[1 : 1 + len(keep)], F.when(found, name).otherwise(UND).alias("lang_pred"), score.alias("score"))
