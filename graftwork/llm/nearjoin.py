"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word 5-grams. Equal texts are one *class representative* with a weight (its copies). Then:

1. Each representative gets BANDS x ROWS MinHash values. Two that agree in all rows of a band meet in a bucket. A pair of
   similarity 0.8 is missed by all bands with probability (1 - 0.8^4)^24 < 4e-6.
2. Representatives in buckets of two or more get a home: two rounds of taking the smallest representative met through a bucket.
   A home's members are split into chunks of CHUNK, so no group grows with the data. Chunks that meet in a bucket form a
   chunk pair; each is one group of bounded size, and a pair of representatives belongs to exactly one.
3. In a group, pairs that share a band are candidates. Their MinHash values are compared STEP at a time; after each step a pair
   is dropped when the posterior probability (uniform prior) that its similarity reaches the threshold is under ``tolerance``.
   What survives is verified exactly on the 5-grams themselves.
4. Links are counted where they are verified; they aren't emitted. What leaves a group is a link count and a spanning forest
   for its members, so rows grow with documents, not with pairs. Connected components over those edges are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast_if_small, column_of, discard, hash_words, materialize, slices, small_batches, split_words, window_hashes

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
CHUNK = 256
#: Shares that the copies of one text are dealt to when they get their class.
SALTS = 8


@lru_cache(1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a text of fewer words is one n-gram, one without words none."""
    words = split_words(text)
    if not words:
        return np.empty(0, U64)
    h = hash_words(words)
    return np.unique(window_hashes(h, min(size, len(h))) if len(h) >= size else window_hashes(h, len(h)) ^ U64(len(h)))


def signature(s: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    x = (s >> U64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            v = a[:, None] * part
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v += b[:, None]
            np.minimum(out, v.min(1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of a matrix of signatures."""
    data = np.ascontiguousarray(sig.reshape(-1, BANDS, ROWS)).view(np.uint64).reshape(-1, BANDS, ROWS // 2)
    with np.errstate(over="ignore"):
        x = data[:, :, 0] * U64(0x9E3779B97F4A7C15) ^ (data[:, :, 1] * U64(0xC2B2AE3D27D4EB4F) >> U64(7)) * U64(0x165667B19E3779F9)
        x ^= x >> U64(32)
        return x * U64(0xD6E8FEB86659FD93) + np.arange(BANDS, dtype=U64)


@lru_cache(16)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ... compared values: the fewest matches at which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = [sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) for m in range(n + 1)]
        out.append(next(m for m, p in enumerate(tail) if p >= tolerance))
    return tuple(out)


def _prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (a[i, part] == b[j, part]).sum(1, dtype=np.int32)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def link(members: list[tuple[int, np.ndarray, np.ndarray, bool]], within: bool, threshold: float, tolerance: float) -> Iterator[tuple[int, int]]:
    """Positions of the verified pairs of a group: (id, signature, shingles, whether of the first chunk) of each member."""
    left = [k for k, m in enumerate(members) if m[3]]
    right = left if within else [k for k, m in enumerate(members) if not m[3]]
    if not left or not right:
        return
    sig = np.stack([m[1] for m in members])
    key = bands(sig)
    words, place = np.unique(np.concatenate([members[k][2] for k in range(len(members))]), return_inverse=True)
    size = np.array([len(m[2]) for m in members])
    ends = np.cumsum(size)
    all_right = np.concatenate([place[ends[k] - size[k] : ends[k]] for k in right])
    starts = np.r_[0, np.cumsum(size[right])[:-1]]
    mark = np.zeros(len(words), np.int32)
    right = np.array(right)
    for n, k in enumerate(left):
        others = np.arange(n + 1 if within else 0, len(right))
        near = others[(key[right[others]] == key[k]).any(1)]
        if not len(near):
            continue
        _, j = _prune(sig, sig, np.full(len(near), k), right[near], threshold, tolerance)
        if not len(j):
            continue
        own = place[ends[k] - size[k] : ends[k]]
        mark[own] = 1
        if len(j) * 4 > len(right):
            common = np.add.reduceat(mark[all_right], starts)[np.searchsorted(right, j)]
        else:
            common = np.array([mark[place[ends[x] - size[x] : ends[x]]].sum() for x in j])
        mark[own] = 0
        # common / union >= threshold, on whole numbers as far as the threshold allows
        good = common * (1 + threshold) >= threshold * (size[k] + size[j]) - 1e-9
        for x in j[good].tolist():
            yield k, x


def _digest(text: bytes | None) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text or b"")
    return d & ((1 << 63) - 1), d >> 65


def _profile(rows: DataFrame) -> DataFrame:
    """(doc, text) -> doc, two hashes of the words, the signature's bands; a text without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                digest, keys = [], []
                for text in column_of(batch, "text"):
                    s = shingles(text)
                    digest.append(_digest(text))
                    keys.append(bands(signature(s)[None])[0].view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*digest, strict=True)), pa.array(keys, pa.list_(pa.int64()))], ["doc", "d1", "d2", "bands"])

    return small_batches(rows).mapInArrow(run, "doc long, d1 long, d2 long, bands array<long>")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node -> label, the smallest node of its component. nodes(node), edges(a, b).

    Each round takes the smallest label among neighbours and then the label of that label; every round is written to the
    shared folder. Rounds grow with the logarithm of a component's diameter, roughly; groups have handed over forests
    already, so few are needed.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    old = label = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = materialize(step.join(jump, step["label"] == jump["n2"], "left").select("node", "old", F.least("label", "l2").alias("label")), "labels")
        discard(old)
        old, label = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            discard(both)
            return label


def near_classes(df: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id linked to it, directly or not), n_links (documents linked to it directly).

    A row for each row of ``df``. Linked: equal texts, or 5-gram Jaccard similarity of at least ``threshold``. Texts of under
    5 words are one n-gram; texts that are null or have no words are linked with none, as are rows with a null id, which
    have a null class. Rows with one id and equal text count once. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = df.select(df[id_col].cast("long").alias("doc"), df[text_col].cast("string").alias("text"))
    profile = materialize(_profile(rows), "profile")
    some = profile.where("doc is not null and bands is not null")
    # the same digest has the same bands: copies are put together before anything is compared
    each = some.groupBy("doc", "d1", "d2").agg(F.any_value("bands").alias("bands"))
    reps = each.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    # one id may have several texts: a representative is known by its number, made of both hashes
    rid = F.xxhash64("d1", "d2")
    own = materialize(reps.withColumn("rid", rid), "reps")
    met = own.select("rid", F.posexplode("bands").alias("band", "key")).distinct()
    crowded = met.groupBy("band", "key").agg(F.min("rid").alias("least"), F.max("rid").alias("most")).where("least < most")
    buckets = materialize(met.join(crowded.select(F.col("band").alias("b2"), F.col("key").alias("k2"), "least"), (F.col("band") == F.col("b2")) & (F.col("key") == F.col("k2"))).select("rid", "band", "key", "least"), "buckets")
    home = buckets.groupBy("rid").agg(F.min("least").alias("home"))
    again = buckets.join(home.withColumnRenamed("rid", "r2"), F.col("rid") == F.col("r2")).groupBy("band", "key").agg(F.min("home").alias("h")).withColumnsRenamed({"band": "b2", "key": "k2"})
    home = materialize(buckets.join(again, (F.col("band") == F.col("b2")) & (F.col("key") == F.col("k2"))).groupBy("rid").agg(F.min("h").alias("home")), "homes")
    chunks = home.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("parts")).withColumnRenamed("home", "h2")
    homed = home.join(chunks, F.col("home") == F.col("h2")).select("rid", F.xxhash64("home", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("parts"))).alias("chunk"))
    homed = materialize(homed, "chunks")
    places = buckets.join(homed.withColumnRenamed("rid", "r2"), F.col("rid") == F.col("r2")).select("band", "key", "chunk").distinct()
    other = places.select(F.col("band").alias("b2"), F.col("key").alias("k2"), F.col("chunk").alias("c2"))
    pairs = materialize(places.join(other, (F.col("band") == F.col("b2")) & (F.col("key") == F.col("k2")) & (F.col("chunk") <= F.col("c2"))).select(F.col("chunk").alias("c1"), "c2").distinct(), "pairs")

    weight = own.select("doc", "d1", "d2", "rid", "copies")
    wanted = materialize(weight.join(homed.withColumnRenamed("rid", "r2"), F.col("rid") == F.col("r2")).drop("r2"), "wanted")
    joined = rows.join(broadcast_if_small(wanted.withColumnRenamed("doc", "d"), F.lit(80)), F.col("doc") == F.col("d")).select("text", "d1", "d2", "rid", "copies", "chunk")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = column_of(batch, "text")
                # of the texts of one id, the one that is meant
                meant = [i for i, (t, d1, d2) in enumerate(zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if _digest(t) == (d1, d2)]
                found = [shingles(texts[i]) for i in meant]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(meant, pa.int64())) for c in (3, 4, 5)), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([signature(x).tobytes() for x in found], pa.binary())], ["rid", "copies", "chunk", "sets", "sig"])

    full = small_batches(joined).mapInArrow(sets, "rid long, copies long, chunk long, sets binary, sig binary")
    first = pairs.select(F.col("c1").alias("c"), F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.lit(True).alias("first"))
    second = pairs.where("c1 <> c2").select(F.col("c2").alias("c"), F.col("c1").alias("x1"), F.col("c2").alias("x2"), F.lit(False).alias("first"))
    members = full.join(first.unionByName(second), F.col("chunk") == F.col("c")).select("x1", "x2", "first", "rid", "copies", "sets", "sig")
    groups = members.repartition("x1", "x2").sortWithinPartitions("x1", "x2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            within = at[0] == at[1]
            members = list({(m[0], m[3]): m for m in held}.values())  # rows with one id and text
            up = list(range(len(members)))

            def find(k: int) -> int:
                while up[k] != k:
                    up[k] = k = up[up[k]]
                return k

            links, edges = [0] * len(members), []
            for a, b in link(members, within, threshold, tolerance):
                links[a] += members[b][4]
                links[b] += members[a][4]
                if (x := find(a)) != (y := find(b)):
                    up[max(x, y)] = min(x, y)
            out = [(m[0], members[find(k)][0], links[k]) for k, m in enumerate(members) if links[k] or find(k) != k]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 3)], ["a", "b", "links"])

        at, held = None, []
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for x1, x2, is_first, r, copies, data, sig in zip(*cols, strict=True):
                if (x1, x2) != at:
                    if held:
                        yield flush()
                    at, held = (x1, x2), []
                held.append((r, np.frombuffer(sig, np.uint32), np.frombuffer(data, U64), is_first, copies))
        if held:
            yield flush()

    linked = materialize(small_batches(groups).mapInArrow(verify, "a long, b long, links long"), "links")
    discard(buckets, home, homed, pairs, wanted)
    counts = linked.groupBy(F.col("a").alias("r2")).agg(F.sum("links").alias("near"))
    label = components(linked.select(F.col("a").alias("node")).union(linked.select("b")).distinct(), linked)
    named = weight.join(label, F.col("rid") == F.col("node")).select("doc", "rid", "label")
    least = named.groupBy("label").agg(F.min("doc").alias("class_id")).withColumnRenamed("label", "l2")
    classes = named.join(least, F.col("label") == F.col("l2")).select(F.col("rid").alias("r3"), "class_id")
    by_rep = weight.select("rid", "doc", "copies").join(counts, F.col("rid") == F.col("r2"), "left").join(classes, F.col("rid") == F.col("r3"), "left")
    by_rep = by_rep.where("copies > 1 or class_id is not null").select("rid", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # all copies of a text meet in one row: it is laid out SALTS times, and they are dealt to these
    by_rep = by_rep.withColumn("s2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = profile.select("doc", F.when(F.col("bands").isNotNull() & F.col("doc").isNotNull(), rid).alias("r"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("s"))
    out = out.join(by_rep, (F.col("r") == F.col("rid")) & (F.col("s") == F.col("s2")), "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(df: DataFrame, **how) -> DataFrame:
    """One row of each class, that with the smallest id, with the columns of ``df``; a null id comes after all others.

    Decided by row: of one id's rows those whose own text has an earlier near copy go, and repeated rows and copies with null
    ids are copies like any others. Rows with a text that is null or has no words all stay.
    """
    names = df.columns
    id_col, text_col = (f"kept_{names.index(how.pop(c, d))}" for c, d in (("id_col", "doc_id"), ("text_col", "text")))
    df = df.toDF(*(f"kept_{i}" for i in range(len(names))))  # no name of the user's can be one of ours
    if df.where(F.col(id_col).isNull()).isEmpty() and df.groupBy(id_col).count().where("count > 1").isEmpty():
        rows, key = df, id_col
    else:  # ids don't tell rows apart: numbers in the order of ids take their place
        ordered = df.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col), F.xxhash64(*df.columns))
        rows, key = materialize(ordered.withColumn("number_of_row", F.monotonically_increasing_id()), "numbered"), "number_of_row"
    gone = near_classes(rows, **how, id_col=key, text_col=text_col).where("class_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return rows.join(gone, F.col(key) == F.col("gone_id"), "left_anti").select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)))
