"""Quality rules: log-likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

Words, word pairs, the forms of words, pairs and triples of forms, and of each pair whether it is one word twice, are hashed into
``buckets``. Two smoothed multinomials are
counted: one over the trusted documents, one over every document of the corpus. A document's score is the mean, over its own
n-grams, of log(trusted / corpus): the log-likelihood ratio divided by the length, so long texts aren't favoured. It is kept if
that is at least ``threshold``; nothing is drawn at random.

The form of a word (its case, its letters' share and the marks at its end) tells about documents whose words were never seen before.

Texts are read a slice of a batch at a time: all words of the slice become numbers once, and everything else is arithmetic on
arrays over all of its words, with the document of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, U64, column_of, mix64, slices, small_batches, split_words, window_hashes

#: A power of two.
BUCKETS = 1 << 17
#: Documents whose labels say they are good, at most: the model is fitted on this many of them, by a hash of their id.
TRUSTED_ROWS = 20_000
#: Counts that the trusted side is thought to have in each bucket beforehand, in the corpus's proportion: rare n-grams say little.
PRIOR = 2.0
#: A document scoring below is not kept.
THRESHOLD = -0.2
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
WINDOW = 8
#: Bytes of text that are looked at together.
SLICE = 2 << 20
MIN_WORDS = 20
MOST_REPEATED = (30, 100)


def _shape(word: bytes) -> bytes:
    """The form of a word: case, letters or not, and what it ends with."""
    core = word.rstrip(b".,;:!?#*$%&|<>")
    case = b"-" if not core else b"U" if core.isupper() and len(core) > 1 else b"T" if core[:1].isupper() else b"l" if core.islower() else b"x"
    return b"\0" + case + word[len(core) :][:4]


class _Numbers(dict):
    """word -> its number; words met for the first time are put on a list."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class _Vocabulary:
    """Hash, hash of the form and characters of each word met so far; it starts anew when it has grown too large."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.facts = np.empty((3, 0), U64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """[hash, form, characters] x word"""
        if len(self.numbers) > CACHE_ENTRIES:
            self.__init__()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if new := self.numbers.new:
            hashes = (map(xxhash.xxh3_64_intdigest, new), map(xxhash.xxh3_64_intdigest, map(_shape, new)), (len(x.decode()) for x in new))
            self.facts = np.concatenate([self.facts, np.stack([np.fromiter(x, U64, len(new)) for x in hashes])], axis=1)
            self.numbers.new = []
        return self.facts[:, at]


_vocabulary = _Vocabulary()


class Words:
    """All words of several texts: hash, form (its hash), characters, and the text that each is in."""

    def __init__(self, texts: list[bytes | None]) -> None:
        each = [split_words(x) for x in texts]
        self.texts = len(texts)
        self.count = np.fromiter(map(len, each), np.int64, len(each))
        self.hash, self.form, self.chars = _vocabulary.look_up([w for x in each for w in x])
        self.doc = np.repeat(np.arange(len(each)), self.count)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words within a text, and where they start."""
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :]) if len(h) >= n else np.empty(0, np.int64)
        return window_hashes(h, n)[at], at


def features(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and the text of each."""
    with np.errstate(over="ignore"):
        pair, at2 = w.windows(w.hash, 2)
        again = np.where(w.hash[at2] == w.hash[at2 + 1], U64(1), U64(2)) if len(at2) else pair
        form2, _ = w.windows(w.form, 2)
        form3, at3 = w.windows(w.form, 3)
        grams = [mix64(w.hash), mix64(w.form), pair, form2, again, form3]
    return (np.concatenate(grams) & U64(buckets - 1)).astype(np.int64), np.concatenate([w.doc, w.doc, *[w.doc[at2]] * 3, w.doc[at3]])


def repeated_words(w: Words) -> np.ndarray:
    """For each text, its words in windows of 8 words that occur twice or more in the text, the first one included."""
    found, at = w.windows(w.hash, WINDOW)
    with np.errstate(over="ignore"):
        key = mix64(found + w.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 1, np.int32)
    edge[at[twice]] += 1
    edge[at[twice] + WINDOW] -= 1
    return np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=w.texts)


def count_grams(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """(text, trusted) -> counts [trusted or corpus, bucket]; the corpus counts every row. The result has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                bucket, doc = features(Words(column_of(batch, "text")), buckets)
                trusted = np.array(batch.column(batch.schema.get_field_index("trusted")).to_pylist(), bool)
                total[1] += np.bincount(bucket, minlength=buckets)
                total[0] += np.bincount(bucket[trusted[doc]], minlength=buckets)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "trusted", "corpus"])

    sums = small_batches(docs).mapInArrow(count, "bucket int, trusted long, corpus long").groupBy("bucket").agg(F.sum("trusted"), F.sum("corpus"))
    out = np.zeros((2, buckets))
    for bucket, trusted, corpus in sums.toPandas().itertuples(index=False):
        out[:, bucket] = trusted, corpus
    return out


def fit(df: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(trusted / corpus) of each bucket. ``labels``: doc_id, quality (1: good).

    Corpus counts cover all rows; the trusted side is fitted on at most ``trusted_rows`` labelled documents, those whose
    hashed ids are smallest. All zeros (every document scores 0) if none is labelled good.
    """
    best = labels.where("quality = 1").select(labels["doc_id"].alias("good")).where("good is not null").distinct().orderBy(F.xxhash64("good"), "good").limit(trusted_rows)
    docs = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    marked = docs.join(F.broadcast(best), F.col("id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("trusted"))
    counts = count_grams(marked, buckets)
    if not counts[0].sum():
        return np.zeros(buckets, np.float32)
    expected = counts[1] * (counts[0].sum() / counts[1].sum())
    return np.log((counts[0] + PRIOR) / (expected + PRIOR)).astype(np.float32)


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(df: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, llr (the length-normalised log-likelihood ratio), columns of ``keep``.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. A null or empty text has no words,
    fails and has llr 0. Null ids stay null, repeated rows each give a row, other columns are ignored, an empty table gives an
    empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(ratio)
    chosen = df.select(df[id_col].alias("doc_id"), *(df[c].alias(f"kept_{c}") for c in keep), df[text_col].cast("string").alias("text"))
    kept = chosen.schema.fields[1:-1]
    schema = ", ".join([f"doc_id {chosen.schema[0].dataType.simpleString()}", *(f"{c} long" for c in _LONGS), "base_failed boolean, kept boolean, llr double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])

    def lines(text: bytes | None) -> int:
        if not text or b"\n" not in text:
            return 0
        some = [x for x in text.split(b"\n") if x.strip()]
        return len(some) - len(set(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = column_of(batch, "text")
                w = Words(texts)
                bucket, doc = features(w, len(ratio))
                llr = np.bincount(doc, ratio[bucket], w.texts) / np.maximum(np.bincount(doc, minlength=w.texts), 1)
                repeated = repeated_words(w)
                failed = (w.count < MIN_WORDS) | (MOST_REPEATED[1] * repeated > MOST_REPEATED[0] * w.count)
                longs = [w.count, np.bincount(w.doc, w.chars.astype(np.float64), w.texts).astype(np.int64), [sum(map((x or b"").count, SYMBOLS)) for x in texts], list(map(lines, texts)), repeated]
                cols = [*(pa.array(x, pa.int64()) for x in longs), pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *batch.columns[1:-1]], ["doc_id", *_LONGS, "base_failed", "kept", "llr", *(f.name for f in kept)])

    return small_batches(chosen).mapInArrow(run, schema)


def kept_documents(df: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with the columns of ``df`` whatever their names.

    A null or empty text fails the rules; rows with a null id and repeated rows are judged each; an empty table stays empty.
    """
    rest = tuple(c for c in df.columns if c != "doc_id")
    out = score(df, ratio, threshold, keep=rest).where("kept")
    return out.select(*(F.col("doc_id" if c == "doc_id" else f"kept_{c}").alias(c) for c in df.columns))
