"""Substring dedup: remove the words of passages that an earlier document has.

A window is ``length`` consecutive words. Each window names one anchor: the smallest hash among its runs of ANCHOR words, so
equal windows name equal anchors, wherever they stand. Consecutive windows with one anchor form a *context* of at most
2 * length - ANCHOR words. Contexts are the unit of work:

1. Anchors that stand in one document alone can't hold a shared window; that is told by an aggregate over anchor hashes.
2. Each different context of the other anchors is a reference passage, owned by the smallest document that has it.
3. Reference passages are dealt to shards by anchor, and each shard gets a suffix automaton of its passages, whose states know
   the smallest document they end in. The contexts of the shard's documents stream through it; the matching statistic says at
   each word how long a suffix is known, and at ``length`` words or more the state says which document had it first. A context
   can only match in its anchor's shard, so the automaton is sent to where these are, not to all; equal contexts stream once.
4. An anchor with over CROWD different passages is too much for a shard. Its passages are cut into windows, each of which is a
   passage of its own, dealt by its own hash to the same shards and matched by the same automata.
5. Owners that are smaller than a document mark windows in it; the words under marks are removed, in maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast_if_small, column_of, discard, hash_words, materialize, mix64, slices, small_batches, split_words, window_hashes

LENGTH = 50
ANCHOR = 32
#: Passages of an anchor that a shard takes as they are; those of larger anchors are cut into windows.
CROWD = 500
SHARD_PASSAGES = 1000
_POS = 28
_MULT = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_MULT, _INVERSE)):
            _powers[i] = np.cumprod(np.r_[np.ones(1, U64), np.full(2 * n, base, U64)])
    return _powers[0], _powers[1]


def contexts(h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, first window and number of windows of each context of a document's word hashes."""
    n = len(h) - length + 1
    most = 1 << _POS
    if len(h) > most:  # longer texts are cut so that each window lies in one part; a context that is cut is two
        step = most - length + 1
        parts = [(a, contexts(h[a : a + most], length)) for a in range(0, n, step)]
        return tuple(np.concatenate([got[k] + a if k == 2 else got[k] for a, got in parts]) for k in range(4))
    if n <= 0:
        return (np.empty(0, U64),) * 2 + (np.empty(0, np.int64),) * 2
    anchor = min(ANCHOR, length)
    g = window_hashes(h, anchor)
    key = (g >> U64(_POS) << U64(_POS)) | np.arange(len(g), dtype=U64)
    width, low = length - anchor + 1, key
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    at = (low & U64((1 << _POS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    up, down = _power(len(h))
    with np.errstate(over="ignore"):
        total = np.r_[np.zeros(1, U64), np.cumsum(h * up[: len(h)])]
        ctx = mix64((total[first + count + length - 1] - total[first]) * down[first] + count.astype(U64))
    return g[at[first]], ctx, first, count


class Automaton:
    """A suffix automaton of several passages; ``owner`` of a state: the smallest document in which its strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.owner = [-1], [0], [1 << 63]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.owner.append(1 << 63)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], owner: int) -> None:
        last = 0
        for c in words:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.len[p] + 1 == self.len[q] else self._split(p, c, q)
            else:
                last = self._state(self.len[p] + 1, {}, 0)
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[last] = q if self.len[p] + 1 == self.len[q] else self._split(p, c, q)
            self.owner[last] = min(self.owner[last], owner)

    def close(self) -> None:
        """Hand owners down: what ends in a document also ends there as a suffix."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[v]
            if self.owner[v] < self.owner[up]:
                self.owner[up] = self.owner[v]

    def first_owners(self, words: list[int], length: int) -> list[int | None]:
        """For each window of a text: the smallest document that has it, or None. By matching statistics, cut at ``length``."""
        v, match, out = 0, 0, []
        nxt, link, size = self.next, self.link, self.len
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                match = size[v]
            if c in nxt[v]:
                v, match = nxt[v][c], match + 1
            while v and size[link[v]] >= length:
                v = link[v]
            match = min(match, size[v])
            if i >= length - 1:
                out.append(self.owner[v] if match >= length else None)
        return out


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                cols: list[list] = [[], [], [], []]
                reps = []
                for text in column_of(batch, "text"):
                    got = contexts(hash_words(split_words(text)), length)
                    reps.append(len(got[0]))
                    for c, x in zip(cols, got, strict=True):
                        c.append(x)
                fp, ctx, first, count = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
                if not len(fp):
                    continue
                row = np.repeat(np.arange(batch.num_rows), reps)
                # a context that stands several times in one document is one row with all of its places
                with np.errstate(over="ignore"):
                    key = mix64(fp + ctx * U64(_MULT) + mix64(row.astype(U64)))
                order = np.argsort(key, kind="stable")
                new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                one = order[new]
                firsts = pa.ListArray.from_arrays(pa.array(np.r_[new, len(order)].astype(np.int32)), pa.array(first[order].astype(np.int32)))
                take = pa.array(row[one])
                yield pa.RecordBatch.from_arrays([pa.array(fp[one].view(np.int64)), pa.array(ctx[one].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), firsts, pa.array(count[one].astype(np.int32))], ["fp", "ctx", "doc", "th", "firsts", "n"])

    return small_batches(docs).where("doc is not null and text is not null").mapInArrow(run, "fp long, ctx long, doc long, th long, firsts array<int>, n int")


def _passages(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """fp, ctx, doc, words (hashes) of passages; ``wanted``: doc, th, and first: the window that each begins with."""
    lists = materialize(wanted.groupBy("doc", "th").agg(F.collect_list("first").alias("firsts")).withColumnsRenamed({"doc": "d", "th": "t"}), "wanted")
    lists = broadcast_if_small(lists, F.lit(64) + 4 * F.size("firsts"))
    found = docs.join(lists, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t"))).select("doc", "text", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows = []
                for doc, text, firsts in zip(batch.column(0).to_pylist(), column_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                    h = hash_words(split_words(text))
                    fp, ctx, first, count = contexts(h, length)
                    at = np.searchsorted(first, np.array(firsts, np.int64))
                    for f, c, a, n in zip(fp[at].view(np.int64).tolist(), ctx[at].view(np.int64).tolist(), first[at].tolist(), count[at].tolist(), strict=True):
                        rows.append((f, c, doc, h[a : a + n + length - 1].tobytes()))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["fp", "ctx", "doc", "words"])

    # a document met by two rows of the same id and text gives its passages twice
    return small_batches(found).mapInArrow(run, "fp long, ctx long, doc long, words binary").dropDuplicates(["fp", "ctx"])


def _owners(passages: DataFrame, length: int) -> DataFrame:
    """fp, ctx, owners: for each window of a passage, the smallest document that has it."""
    passages = materialize(passages, "passages")
    crowd = materialize(passages.groupBy("fp").count().where(F.col("count") > CROWD).select(F.col("fp").alias("hot")), "crowd")
    crowd = broadcast_if_small(crowd, F.lit(32))
    schema = "fp long, ctx long, owners array<long>"

    def match(table: pa.Table) -> pa.Table:
        auto = Automaton()
        words = [np.frombuffer(x, U64).tolist() for x in table["words"].to_pylist()]
        for w, doc in zip(words, table["doc"].to_pylist(), strict=True):
            auto.add(w, doc)
        auto.close()
        return pa.table({"fp": table["fp"], "ctx": table["ctx"], "owners": pa.array([auto.first_owners(w, length) for w in words], pa.list_(pa.int64()))})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x, U64) for x in column_of(batch, "words")]
            each = [window_hashes(x, length) for x in words]
            take = pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, each))))
            no = np.concatenate([np.arange(len(x)) for x in each]) if each else np.empty(0, np.int64)
            w = np.concatenate(each) if each else np.empty(0, U64)
            cut = [x[k : k + length].tobytes() for x, y in zip(words, each, strict=True) for k in range(len(y))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(no.astype(np.int32)), pa.array(w.view(np.int64)), pa.array(cut, pa.binary())], ["fp", "ctx", "doc", "no", "w", "words"])

    usual = passages.join(crowd, F.col("fp") == F.col("hot"), "left_anti").select("fp", "ctx", "doc", "words")
    hot = passages.join(crowd, F.col("fp") == F.col("hot"), "left_semi").select("fp", "ctx", "doc", "words").repartition("fp", "ctx")
    cut = materialize(hot.mapInArrow(windows, "fp long, ctx long, doc long, no int, w long, words binary"), "windows")
    own = cut.groupBy("w").agg(F.min("doc").alias("doc"), F.min("words").alias("words")).select(F.col("w").alias("fp"), F.lit(None).cast("long").alias("ctx"), "doc", "words")
    together = materialize(usual.unionByName(own), "references")
    discard(passages)
    shards = max(1, together.count() // SHARD_PASSAGES)
    matched = together.groupBy(F.pmod("fp", F.lit(shards)).alias("shard")).applyInArrow(match, schema)
    matched = materialize(matched, "matched")
    discard(together)
    first = matched.where("ctx is null").select(F.col("fp").alias("v"), F.element_at("owners", 1).alias("owner"))
    of_cut = cut.select("fp", "ctx", "no", "w").join(first, F.col("w") == F.col("v")).groupBy("fp", "ctx").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "owner"))), lambda x: x["owner"]).alias("owners"))
    return matched.where("ctx is not null").unionByName(of_cut)


def _merged(runs: DataFrame) -> DataFrame:
    """(doc, th, runs) -> doc, th, marks: the runs in order, each that begins where another ends joined to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            value = col.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(col.offsets.to_numpy()))
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            first, end = value >> 32, (value >> 32) + (value & 0xFFFFFFFF)
            new = np.r_[True, (row[1:] != row[:-1]) | (first[1:] != end[:-1])] if len(row) else np.empty(0, bool)
            begin = np.flatnonzero(new)
            last = np.r_[begin[1:], len(row)] - 1 if len(begin) else begin
            marks = (first[begin] << 32) + end[last] - first[begin]
            ends = np.searchsorted(row[begin], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(marks, pa.int64()))], ["doc", "th", "marks"])

    return runs.mapInArrow(run, "doc long, th long, marks array<long>")


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, text) -> doc, th, marks: runs of windows that an earlier document has, each as first * 2^32 + number."""
    anchors = materialize(_anchors(docs, length), "anchors")
    kinds = anchors.groupBy("fp").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    # stored, so that the join has a shuffle of its own and large keys can be split in it
    shared = materialize(kinds.where("hi > lo").select(F.col("fp").alias("f")), "kinds")
    met = materialize(anchors.join(shared, F.col("fp") == F.col("f")).drop("f"), "shared")
    discard(anchors, shared)
    own = F.min(F.struct("doc", "th", F.element_at("firsts", 1).alias("first"))).alias("x")
    wanted = met.groupBy("fp", "ctx").agg(own).select("x.*")
    owners = materialize(_owners(_passages(docs, wanted, length), length), "owners").select(F.col("fp").alias("f"), F.col("ctx").alias("c"), "owners")
    run = lambda first, n: F.shiftleft(first.cast("long"), 32) + n
    which = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("owners", i) < F.col("doc"))
    part = met.join(owners, (F.col("fp") == F.col("f")) & (F.col("ctx") == F.col("c"))).where(F.array_min("owners") < F.col("doc")).select("doc", "th", "firsts", "n", which.alias("which"))
    each = F.flatten(F.transform("firsts", lambda f: F.transform("which", lambda i: run(f + i, F.lit(1)))))
    part = part.select("doc", "th", F.when(F.size("which") == F.col("n"), F.transform("firsts", lambda f: run(f, F.col("n")))).otherwise(each).alias("runs"))
    return _merged(part.groupBy("doc", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of kept), kept: the text without what earlier documents have; columns of ``keep``.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller id, judged on the input. A
    text that loses nothing is kept as it is, else the kept words are joined by a space; kept_sha256 is always of the words joined
    by a space. A null text has no words; a document with a null id is compared with none; rows with one id don't
    remove from each other; other columns are ignored; an empty table gives an empty result.
    """
    base = df.select(df[id_col].cast("long").alias("doc"), F.xxhash64(df[text_col]).alias("th"), df[text_col].cast("string").alias("text"))
    found = broadcast_if_small(materialize(marks(base, length), "marks").withColumnsRenamed({"doc": "d", "th": "t"}), F.lit(64) + 8 * F.size("marks"))
    rows = df.select(df[id_col].cast("long").alias("doc"), F.xxhash64(df[text_col]).alias("th"), *(df[c].alias(f"kept_{c}") for c in keep), df[text_col].cast("string").alias("text"))
    rows = rows.join(found, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t")), "left").drop("d", "t", "th")
    others = rows.schema.fields[1:-2]
    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])

    def cut(text: bytes | None, found: list | None) -> tuple:
        words = split_words(text)
        kept, out = words, text
        if found:
            edge = np.zeros(len(words) + 1, np.int32)
            runs = np.array(found, np.int64)
            first = runs >> 32
            np.add.at(edge, first, 1)
            np.add.at(edge, first + (runs & 0xFFFFFFFF) + length - 1, -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), None if out is None else out.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                last = batch.num_columns
                cols = list(zip(*map(cut, column_of(batch, "text"), batch.column(last - 1).to_pylist()), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), *batch.columns[1 : last - 2]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *(f.name for f in others)])

    return small_batches(rows).mapInArrow(run, schema)
