"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks, trained on labelled sentences.

Kernel: two strings are as similar as the sum, over all subsequences of N letters within SPAN positions, of the products of their weights, which
are DECAY for each position that the subsequence takes. So letters put into a word, or left between spaces and signs, lower its
weights but don't hide it. Text is folded to 28 signs: letters without case and accents, other letters, and one space for a run of anything
else; letters that stand alone one after the other are put together ("i d i o t").

Nyström: landmarks are words with a space on either side, and beginnings of words after a space. A string's features are its kernel values with the landmarks, divided by
the landmarks' lengths and whitened by the inverse root of their kernel matrix. A linear machine on these features is a sum
over subsequences again, so all of it folds into one table of 2^20 weights: scoring looks up the subsequences that begin at each letter,
whatever the number of landmarks.

A sentence is judged by its best run of WIDTH letters, a document by its best sentence. Labels belong to documents, so training
looks for the sentences that earn them: in rounds, the best runs of toxic documents' sentences that clean documents don't reach, and those of
clean sentences, hardest first, train the machine, which then chooses anew; toxic sentences also come with letters and spaces put into their words. A repeated sentence counts once, and as clean if a clean document has it.
At last scores become probabilities by a logistic curve.

The sample that is learned from is bounded: TOXIC_DOCS and CLEAN_DOCS documents, SENTENCES of each, CUT letters of each sentence. Every
document is scored whole, a slice of text at a time; the table (4 MB) goes to all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

N, SPAN, DECAY = 4, 7, 0.9
WIDTH = 12
#: Landmarks: words, and beginnings of words, that toxic sentences have more than others, and frequent ones.
TOXIC_LANDMARKS, OTHER_LANDMARKS = 96, 80
#: Letters of the beginnings of words that are landmarks as words are.
STEMS = (4, 5, 6)
LANDMARK_LETTERS = 22
#: A toxic landmark's excess over what its frequency lets expect must reach this share of the greatest one: labels are noisy, and
#: words of a few mislabelled documents stand out as well, but less.
EXCESS = 0.3
#: A toxic document counts as mislabelled if its best sentence scores no more than so many of the clean documents' best ones do.
CLEAN_SHARE = 0.99
TOXIC_DOCS, CLEAN_DOCS, SENTENCES, CUT = 1500, 4000, 64, 256
ROUNDS = 4
#: Times that each toxic sentence is learned with signs put into its words.
DISGUISES = 2
#: Of the machine: how much large weights cost, and how much more an error on a toxic sentence costs than one on a clean sentence.
RIDGE, TOXIC_WEIGHT = 3.0, 5.0
HARDEST = 12_000
#: Letters whose subsequences are looked up at a time.
BLOCK = 1 << 17
THRESHOLD = 0.7
_OTHER = 27
_END = 31
#: Offsets of a subsequence's second to last letter from its first.
_OFFSETS = [c for c in combinations(range(1, SPAN), N - 1)]
_BREAK = re.compile(r"(?<=[.!?])\s|\n")
_SIGNS: np.ndarray | None = None


def _signs() -> np.ndarray:
    """code point -> sign (Basic Multilingual Plane): 1..26 for letters, 27..30 for other letters, 0 for all else."""
    global _SIGNS
    if _SIGNS is None:
        out = np.zeros(0x10000, np.uint8)
        for p in range(0x10000):
            if not (c := chr(p)).isalpha():
                continue
            base = unicodedata.normalize("NFD", c.lower())[0]
            out[p] = ord(base) - 96 if "a" <= base <= "z" else _OTHER + p % 4
        _SIGNS = out
    return _SIGNS


@dataclass
class Folded:
    """Signs of several texts, a space before and after each sentence; ``edge`` has the places of these spaces, ``doc`` each sentence's text."""

    sign: np.ndarray
    edge: np.ndarray
    doc: np.ndarray


def fold(texts: list[str]) -> Folded:
    code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    high = code > 0xFFFF
    sign = _signs()[np.where(high, 32, code)]
    for p in np.flatnonzero(high).tolist():
        sign[p] = _OTHER + int(code[p]) % 4 if chr(code[p]).isalpha() else 0
    doc = np.repeat(np.arange(-1, len(texts), dtype=np.int32), [1, *(len(t) + 1 for t in texts)])
    end = code == 10
    stop, white = (code == 46) | (code == 33) | (code == 63), (code == 32) | ((code >= 9) & (code <= 13))
    end[:-1] |= stop[:-1] & white[1:]
    sign[end] = _END
    # a run of what is no letter is one space, or the edge of a sentence if there is one in it
    letter = (sign > 0) & (sign < _END)
    begins = np.flatnonzero(letter | np.r_[True, letter[:-1]])
    sign, doc = np.maximum.reduceat(sign, begins), doc[begins]
    space = np.flatnonzero((sign == 0) | (sign == _END))
    gap = np.diff(space) - 1
    alone = space[1:-1][(gap[:-1] == 1) & (gap[1:] == 1)] if len(space) > 2 else space[:0]
    alone = alone[sign[alone] == 0]
    if len(alone):
        keep = np.ones(len(sign), bool)
        keep[alone] = False
        sign, doc = sign[keep], doc[keep]
    edge = np.flatnonzero(sign == _END)
    sign[edge] = 0
    return Folded(sign, edge, doc[edge[:-1] + 1])


def _ends(f: Folded) -> np.ndarray:
    """For each place but the last the edge that ends its sentence."""
    return np.repeat(f.edge[1:].astype(np.int32), np.diff(f.edge))


def _sums(f: Folded, table: np.ndarray) -> np.ndarray:
    """For each place the weights of the subsequences that begin there, within its sentence."""
    total = len(f.sign) - 1
    out, ends = np.zeros(max(total, 0), np.float32), _ends(f)
    whole = np.concatenate([f.sign, np.zeros(SPAN, np.uint8)])
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        part = whole[a : b + SPAN].astype(np.int32)
        m, at = b - a, np.arange(a, b)
        shifted = [part[d : d + m] for d in range(SPAN)]
        key, sums = np.empty(m, np.int32), out[a:b]
        second = {d: (shifted[0] << 15) | (shifted[d] << 10) for d in range(1, SPAN - N + 2)}
        third: dict[tuple[int, int], np.ndarray] = {}
        for last in range(N - 1, SPAN):
            own = np.zeros(m, np.float32)
            for o in _OFFSETS:
                if o[-1] == last:
                    if o[:2] not in third:
                        third[o[:2]] = second[o[0]] | (shifted[o[1]] << 5)
                    np.bitwise_or(third[o[:2]], shifted[last], out=key)
                    own += table[key]
            own *= np.float32(DECAY ** (last - N + 1))
            own[at + last > ends[a:b]] = 0
            sums += own
    return out


def _runs(f: Folded, table: np.ndarray) -> np.ndarray:
    """For each place the weights of the WIDTH places from it on, within its sentence."""
    before = np.concatenate([[0.0], np.cumsum(_sums(f, table), dtype=np.float64)])
    out = before[np.minimum(np.arange(WIDTH, len(before) - 1 + WIDTH, dtype=np.int32), _ends(f))]
    out -= before[:-1]
    return out


def _subsequences(word: np.ndarray) -> dict[int, float]:
    """key -> weight of each subsequence of a string of signs."""
    out: dict[int, float] = {}
    for i in range(len(word)):
        for o in _OFFSETS:
            if i + o[-1] < len(word):
                key = (int(word[i]) << 15) | (int(word[i + o[0]]) << 10) | (int(word[i + o[1]]) << 5) | int(word[i + o[2]])
                out[key] = out.get(key, 0.0) + DECAY ** (o[-1] - N + 1)
    return out


class Landmarks:
    """Landmark strings: ``row`` of each of their subsequences, and the matrix [row, feature] that whitens kernel values."""

    def __init__(self, words: list[bytes]) -> None:
        each = [_subsequences(np.frombuffer(w, np.uint8)) for w in words]
        keys = np.array(sorted(set().union(*each)), np.int64)
        phi = np.zeros((len(keys), len(words)))
        for j, one in enumerate(each):
            phi[np.searchsorted(keys, list(one)), j] = list(one.values())
        phi /= np.maximum(np.sqrt((phi * phi).sum(0)), 1e-9)
        value, vector = np.linalg.eigh(phi.T @ phi)
        good = value > 1e-6 * value.max()
        self.keys, self.phi, self.white = keys, phi, phi @ (vector[:, good] / np.sqrt(value[good]))
        self.row = np.full(1 << 20, -1, np.int32)
        self.row[keys] = np.arange(len(keys))

    def table(self, weight: np.ndarray) -> np.ndarray:
        """Weights of features -> weights of subsequences."""
        out = np.zeros(1 << 20, np.float32)
        out[self.keys] = self.white @ weight
        return out

    def features(self, f: Folded, place: np.ndarray) -> np.ndarray:
        """[run, feature] of the runs that begin at ``place``."""
        ends, whole = _ends(f), np.concatenate([f.sign, np.zeros(SPAN + WIDTH, np.uint8)])
        out = np.empty((len(place), self.white.shape[1]))
        for k in range(0, len(place), 512):
            first = place[k : k + 512]
            at = first[:, None] + np.arange(WIDTH)
            end = ends[first][:, None]
            count = np.zeros((len(first), len(self.keys)))
            for o in _OFFSETS:
                a, b, c, d = (whole[at + k].astype(np.int32) for k in (0, *o))
                row = self.row[(a << 15) | (b << 10) | (c << 5) | d]
                i, j = np.nonzero((row >= 0) & (at + o[-1] <= end) & (at < end))
                np.add.at(count, (i, row[i, j]), DECAY ** (o[-1] - N + 1))
            out[k : k + 512] = count @ self.white
        return out


def _together(sentences: list[bytes]) -> Folded:
    """Folded sentences, each a text of its own."""
    return Folded(np.frombuffer(b"".join(s[:-1] for s in sentences) + b"\0", np.uint8), np.cumsum([0, *(len(s) - 1 for s in sentences)]), np.arange(len(sentences)))


def _disguised(sentence: bytes, rng: np.random.Generator) -> bytes:
    """The sentence with a letter or a space put into each longer word."""
    out = []
    for w in sentence.split(b"\0"):
        if len(w) >= N:
            at = int(rng.integers(1, len(w)))
            w = w[:at] + bytes([int(rng.integers(0, _OTHER))]) + w[at:]
        out.append(w)
    return b"\0".join(out)


def _best(f: Folded, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence's best run begins, and its value."""
    run = _runs(f, table)
    best = np.maximum.reduceat(run, f.edge[:-1])
    return f.edge[:-1] + np.array([int(run[a:b].argmax()) for a, b in zip(f.edge, f.edge[1:], strict=False)]), best


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of the least squared hinge loss, labels 1 and -1, by Newton's method on the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + np.diag(penalty), a.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a f + b))) of the labels, toxic ones weighted as in the machine; targets are kept off 0 and 1 by as
    much as few rows ask for."""
    t, weight = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)), np.where(y, TOXIC_WEIGHT, 1.0)
    x, w = np.stack([f, np.ones(len(f))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.clip(np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (t - p)) - 1e-3 * w), -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


@dataclass
class Model:
    """table of weights, and the logistic curve (a, b) of a document's best run; without a table nothing was learned."""

    table: np.ndarray | None
    a: float = 0.0
    b: float = -4.0


def _marks(word: bytes) -> list[bytes]:
    """What can be a landmark of a word: itself between spaces, and its beginnings after a space, which inflected words share."""
    return [b"\0" + word[:LANDMARK_LETTERS] + b"\0", *(b"\0" + word[:n] for n in STEMS if len(word) > n)]


def learn(texts: list[str], toxic: np.ndarray) -> Model:
    """From texts, sentence by sentence, and whether each one's document is toxic."""
    if not toxic.any() or toxic.all():
        return Model(None)
    f = fold(texts)
    label, of = toxic[f.doc], f.doc
    strings = [f.sign[a : b + 1].tobytes() for a, b in zip(f.edge, f.edge[1:], strict=False)]
    clean = {s for s, x in zip(strings, label, strict=True) if not x}
    seen: set[bytes] = set()
    new = np.array([not (s in seen or seen.add(s)) for s in strings])  # a sentence counts where it stands first
    label = label & np.array([s not in clean for s in strings])
    # landmarks: words and their beginnings by the number of texts of each kind that have them, in sentences that no earlier text has
    counts: dict[bytes, list[int]] = {}
    held: tuple[set[bytes], set[bytes]] = set(), set()
    for k, s in enumerate(strings):
        if new[k]:
            held[int(label[k])].update(x for w in s.split(b"\0") if len(w) >= N - 1 for x in _marks(w))
        if k + 1 == len(strings) or of[k + 1] != of[k]:
            for x, words in enumerate(held):
                for w in words:
                    counts.setdefault(w, [0, 0])[x] += 1
                words.clear()
    if not counts:
        return Model(None)
    names = sorted(counts)
    n, p = np.array([counts[w] for w in names], float).T
    share = len(np.unique(of[label & new])) / len(np.unique(of[new]))
    excess = (p - share * (n + p)) / np.sqrt(share * (n + p) + 1)
    order = np.lexsort((names, -excess))[:TOXIC_LANDMARKS]
    marks = [int(i) for i in order if p[i] > 1 and excess[i] > max(1, EXCESS * excess.max())]
    if not marks:
        return Model(None)
    common = [int(i) for i in np.lexsort((names, -(n + p))) if int(i) not in set(marks)][:OTHER_LANDMARKS]
    landmarks = Landmarks([names[i] for i in [*marks, *common]])
    table = np.zeros(1 << 20, np.float32)
    table[landmarks.keys] = landmarks.phi[:, : len(marks)] @ excess[marks] / excess[marks].max()
    place, rng, trusted = np.empty(0, np.int64), np.random.default_rng(1), toxic.copy()
    for _ in range(ROUNDS):
        start, best = _best(f, table)
        # of a toxic document the sentences that clean documents don't reach, of the clean sentences the hardest
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, of, best)
        least = np.quantile(top[~toxic & np.isfinite(top)], CLEAN_SHARE)
        trusted &= top > least  # who is out stays out: the machine learns what it is given
        earned = np.flatnonzero(trusted[of] & label & new & (best > least))
        chosen = earned[np.argsort(-best[earned], kind="stable")[:HARDEST]]
        if not len(chosen):
            return Model(None)
        others = np.flatnonzero(~label & new)
        others = others[np.argsort(-best[others], kind="stable")[:HARDEST]]
        place = np.unique(np.r_[place, start[others]])
        odd = _together([_disguised(strings[i], rng) for i in np.tile(chosen, DISGUISES)])
        x = np.concatenate([landmarks.features(odd, _best(odd, table)[0]), landmarks.features(f, np.r_[start[chosen], place])])
        y = np.r_[np.ones((1 + DISGUISES) * len(chosen)), -np.ones(len(place))]
        w, bias = machine(x, y, np.where(y > 0, TOXIC_WEIGHT, 1.0))
        table = landmarks.table(w)
    score = np.full(len(texts), bias)
    np.maximum.at(score, of, np.maximum.reduceat(_runs(f, table), f.edge[:-1]) + bias)
    sure = ~toxic | (score > 0)  # a document whose label no sentence earns says nothing about the curve
    a, b = _curve(score[sure], toxic[sure])
    return Model(table, a, b + a * bias)


def _sample(text: str) -> str:
    """At most SENTENCES sentences, evenly spread, of at most CUT letters."""
    every = [s[:CUT] for s in _BREAK.split(text) if s.strip()]
    return "\n".join(every[:: -(-len(every) // SENTENCES) or 1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the texts of labelled documents: at most TOXIC_DOCS and CLEAN_DOCS, the ones with the smallest hashes of their ids.

    An id with several labels is toxic if one of them is. Null ids, labels and texts say nothing; without both labels nothing is learned and
    every score is 0.
    """
    of = labels.select(F.col(id_col).cast("long").alias("learn_id"), F.col(label_col).cast("int").alias("learn_label")).where("learn_id is not null and learn_label is not null").groupBy("learn_id").agg((F.max("learn_label") > 0).alias("is_toxic"))
    some = [of.where(kind).orderBy(F.xxhash64("learn_id"), "learn_id").limit(n) for kind, n in (("is_toxic", TOXIC_DOCS), ("not is_toxic", CLEAN_DOCS))]
    rows = docs.select(docs[id_col].cast("long").alias("d"), docs[text_col].cast("string").alias("text")).where("text is not null")
    met = rows.join(F.broadcast(some[0].unionByName(some[1])), F.col("d") == F.col("learn_id")).select("d", "is_toxic", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_sample(t) for t in batch.column(2).to_pylist()], pa.string())], ["d", "is_toxic", "text"])

    # an id may stand on many rows, so their number is held down too
    sample = small_batches(met).mapInArrow(cut, "d long, is_toxic boolean, text string").orderBy(F.xxhash64("d"), "d", "text").limit(2 * (TOXIC_DOCS + CLEAN_DOCS)).collect()
    return learn([r["text"] for r in sample], np.array([r["is_toxic"] for r in sample], bool)) if sample else Model(None)


#: Letters of a text that are folded at a time; a cut is made after a line or a word, if there is one.
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    while len(text) > PIECE:
        at = max(text.rfind("\n", 0, PIECE), 0) or max(text.rfind(" ", 0, PIECE), 0) or PIECE
        yield text[:at]
        text = text[at:]
    yield text


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, score (0 to 1, the likelihood that a document is toxic).

    A text that is null or has no letters has the score of one without any insult. Null ids stay null, repeated rows each give a row,
    a sentence of over PIECE letters is judged in parts, other columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[id_col].alias("doc_id"), *keep, df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                best = np.zeros(batch.num_rows)
                pieces = [(i, p) for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if t for p in _pieces(t)]
                while model.table is not None and pieces:
                    n = int(np.searchsorted(np.cumsum([len(p) for _, p in pieces]), PIECE)) + 1
                    f = fold([p for _, p in pieces[:n]])
                    if len(f.doc):
                        np.maximum.at(best, np.array([i for i, _ in pieces[:n]])[f.doc], np.maximum.reduceat(_runs(f, model.table), f.edge[:-1]))
                    pieces = pieces[n:]
                p = 1 / (1 + np.exp(-np.clip(model.a * best + model.b, -500, 500))) if model.table is not None else best
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return small_batches(rows).mapInArrow(run, f"{kind}, score double")
