"""Hard-negative mining by norm-bucketed search.

By Cauchy and Schwarz, no candidate scores more with an anchor than the product of their lengths. So candidates are sorted by
norm into buckets of about CHUNK rows, longest first (borders are approximate quantiles of all norms; they decide nothing but which rows lie
together), and a large bucket is dealt to several chunks. A chunk's rows lie in blocks, longest first again.

A search has anchors with windows, each with limits and the number of best candidates it wants. It goes through the buckets in waves of 1, 16 and all
others. A bucket is visited if, for one of the anchor's windows, the length bound reaches the window's lower limit and its k-th
score so far, which travels with the anchor; in a chunk, blocks are left out by the same test with the k-th score of the moment.
First the search runs for the positives, rows of the anchor's label, in one window without limits; what they score sets
the windows of the second search, for rows of other labels.

An anchor meets a chunk in groups of at most QUERY_BLOCK anchors on average, and a group holds one chunk. A label may hold any share of the rows,
since nothing is grouped by it. Vectors of one length all have the same bound: then nothing can be pruned but by the windows'
limits, and the work is that of brute force in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusters import whole_components
from .common import discard, materialize, small_batches
from .topk import EXACT, LONG, _matrix, _narrow, _whole

#: Rows of a chunk, about, and of a block in it.
CHUNK, BLOCK = 4096, 512
BUCKETS = 256
QUERY_BLOCK = 4096
#: Anchors that are compared with a chunk together.
TOGETHER = 256
#: Buckets of a wave: one, then so many times more.
WAVE = 16
#: Bounds are products of rounded roots; this much more covers that.
SLACK = 1 + 1e-9

ANCHOR = "q long, id long, label long, dim int, x array<double>, norm double, lo array<long>, hi array<long>, kth array<long>"


class Chunk:
    """Candidates of one chunk, longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        by = np.lexsort((ids, -norms))
        self.ids, self.labels, self.x, self.norms = ids[by], labels[by], _narrow(x[by]), norms[by]

    def best(self, anchors: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(anchor, window, score, id) of each window's k best candidates here that are as good as its k-th so far.

        ``anchors``: ids, labels, x, norms, and lo, hi, kth as [anchor, window], infinite where there is none."""
        x, lo, hi, kth = anchors["x"], anchors["lo"], anchors["hi"], anchors["kth"].copy()
        found = tuple(np.empty(0, t) for t in (np.int64, np.int64, lo.dtype, np.int64))
        for a in range(0, len(self.x), BLOCK):
            least = np.maximum(lo, kth)
            # whole numbers beyond 2^53 become doubles here, which the slack covers
            limit = least.min(1).astype(np.float64)
            reach = anchors["norms"] * self.norms[a]
            row = np.flatnonzero(reach * SLACK + np.abs(np.where(np.isfinite(limit), limit, 0)) * 1e-12 >= limit)
            if not len(row):
                break  # blocks to come are shorter, and limits only rise
            part = slice(a, a + BLOCK)
            if x.dtype == object:
                score = np.minimum(np.maximum(x[row] @ _whole(self.x[part].astype(np.float64)).T, LONG[0]), LONG[1])
            else:
                score = x[row] @ self.x[part].astype(np.float64).T
            able = ((anchors["labels"][row][:, None] == self.labels[part][None]) == same) & (anchors["ids"][row][:, None] != self.ids[part][None])
            new = []
            for w in range(lo.shape[1]):
                i, j = np.nonzero(able & (score >= least[row, w][:, None]) & (score <= hi[row, w][:, None]))
                new.append((row[i], np.full(len(i), w), score[i, j], self.ids[part][j]))
            q, win, s, v = (np.concatenate([o, *n]) for o, n in zip(found, zip(*new, strict=True), strict=True))
            order = np.lexsort((v, -s, win, q))
            q, win, s, v = q[order], win[order], s[order], v[order]
            group = q * lo.shape[1] + win
            rank = np.arange(len(q)) - np.searchsorted(group, group)
            full, top = rank == k - 1, rank < k
            kth[q[full], win[full]] = np.maximum(kth[q[full], win[full]], s[full])
            found = q[top], win[top], s[top], v[top]
        return found


class Index:
    """``chunks`` (dim, bucket, sub, data) and ``reach``, the greatest norm in each bucket, longest first."""

    def __init__(self, rows: DataFrame) -> None:
        n = rows.count()
        parts = min(BUCKETS, -(-n // CHUNK))
        edges = []
        if parts > 1:
            edges = sorted(set(rows.agg(F.percentile_approx("norm", [i / parts for i in range(1, parts)], 10 * BUCKETS)).first()[0]))
        bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e >= F.col("norm"))) if edges else F.lit(0)
        placed = rows.select("r", "id", "label", "dim", "x", "norm", bucket.cast("int").alias("bucket"))
        stats = materialize(placed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / CHUNK).alias("subs"), F.max("norm").alias("reach")), "buckets")
        of = stats.select(F.col("dim").alias("d"), F.col("bucket").alias("b"), "subs")
        dealt = placed.join(of, (F.col("dim") == F.col("d")) & (F.col("bucket") == F.col("b"))).select("dim", "bucket", F.pmod(F.xxhash64("r"), F.col("subs")).alias("sub"), "id", "label", "x", "norm")

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            dim = key[0].as_py()
            data = Chunk(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["x"].combine_chunks(), dim), table["norm"].to_numpy())
            return pa.table({"dim": pa.array([dim], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "sub": pa.array([key[2].as_py()], pa.int64()), "data": pa.array([pickle.dumps(data)], pa.binary())})

        self.chunks = materialize(dealt.groupBy("dim", "bucket", "sub").applyInArrow(pack, "dim int, bucket int, sub long, data binary"), "chunks")
        self.subs = of
        self.reach = [(r["bucket"], r["reach"]) for r in stats.groupBy("bucket").agg(F.max("reach").alias("reach")).orderBy("bucket").collect()]  # BUCKETS rows


def _visit(routed: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """q, w, score, vec_id: what anchors find in the chunks of the buckets they are routed to."""
    crowds = routed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("copies")).withColumnsRenamed({"dim": "d", "bucket": "b"})
    on = (F.col("dim") == F.col("d")) & (F.col("bucket") == F.col("b"))
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ANCHOR.split(", ")}
    own = [c for c in none if c != "dim"]
    chunks = index.chunks.join(crowds, on).select("dim", "bucket", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), *(none[c] for c in own), "data")
    dealt = routed.join(crowds.join(index.subs, ["d", "b"]), on).select("dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("q"), F.col("copies")).alias("copy"), *own, F.lit(None).cast("binary").alias("data"))
    met = chunks.unionByName(dealt).repartition("dim", "bucket", "sub", "copy").sortWithinPartitions("dim", "bucket", "sub", "copy", F.col("q").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            x = _matrix(rows["x"].combine_chunks(), dim)
            limits = {c: rows[c].to_pylist() for c in ("lo", "hi", "kth")}
            most = max(map(len, limits["lo"]))
            wide = x.shape[1] * max(np.abs(x).max(), 1) * max(np.abs(chunk.x).max(), 1) >= EXACT
            grid = {}
            for c, open_, no_window in (("lo", -np.inf, np.inf), ("hi", np.inf, -np.inf), ("kth", -np.inf, -np.inf)):
                grid[c] = np.array([[open_ if v is None else v for v in vs] + [no_window] * (most - len(vs)) for vs in limits[c]], object if wide else np.float64)
            asked = {"ids": rows["id"].to_numpy(), "labels": rows["label"].to_numpy(), "x": _whole(x) if wide else x, "norms": rows["norm"].to_numpy()} | grid
            q, w, s, v = chunk.best(asked, k, same)
            return pa.RecordBatch.from_arrays([pa.array(rows["q"].to_numpy()[q]), pa.array(w, pa.int32()), pa.array([int(y) for y in s.tolist()], pa.int64()), pa.array(v, pa.int64())], ["q", "w", "score", "vec_id"])

        chunk, dim, held = None, None, []
        for batch in batches:
            data = batch.column(batch.num_columns - 1)
            starts = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                if len(starts) and starts[0] == i:
                    if held:
                        yield flush()
                    chunk, dim, held, starts = pickle.loads(data[i].as_py()), batch.column(0)[i].as_py(), [], starts[1:]
                    i += 1
                    continue
                j = min(i + TOGETHER - sum(b.num_rows for b in held), batch.num_rows, int(starts[0]) if len(starts) else batch.num_rows)
                held.append(batch.slice(i, j - i).drop_columns(["data"]))
                i = j
                if sum(b.num_rows for b in held) >= TOGETHER:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return small_batches(met).mapInArrow(search, "q long, w int, score long, vec_id long")


def _search(anchors: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """q, w, rank, vec_id, score: the k best candidates of each window of anchors (as ANCHOR, without kth)."""
    best = None
    first, after = 0, 1
    while first < len(index.reach):
        if best is None:
            state = anchors.withColumn("kth", F.transform("lo", lambda _: F.lit(None).cast("long")))
        else:
            full = best.where(F.col("rank") == k).groupBy(F.col("q").alias("q2")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("full"))
            state = anchors.join(full, F.col("q") == F.col("q2"), "left").withColumn("kth", F.transform("lo", lambda _, i: F.col("full")[i])).drop("q2", "full")
        least = F.array_min(F.transform("lo", lambda x, i: F.greatest(F.coalesce(x.cast("double"), F.lit(float("-inf"))), F.coalesce(F.get("kth", i).cast("double"), F.lit(float("-inf"))))))
        wave = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(float(r)).alias("reach")) for b, r in index.reach[first:after]))
        slack = F.when(F.abs("least") < float("inf"), F.abs("least") * 1e-12).otherwise(0.0)
        open_ = F.filter(wave, lambda b: (F.col("norm") * b["reach"] * SLACK + slack >= F.col("least")) | (F.isnan(F.col("norm") * b["reach"])))
        routed = state.withColumn("least", least).where("least is not null").withColumn("bucket", F.explode(F.transform(open_, lambda b: b["bucket"]))).drop("least")
        found = _visit(routed, index, k, same)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        before = best
        best = materialize(found.withColumn("rank", F.row_number().over(W.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k), "best")
        if before is not None:
            discard(before)
        first, after = after, after + (after - first) * WAVE
    return best if best is not None else anchors.sparkSession.createDataFrame([], "q long, w int, score long, vec_id long, rank int")


def mine(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, components x being floor(scale * x); higher ones come first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label. For each of them come the first
    ``negatives`` rows of other labels whose score lies within ``window``, per cent of the positive's score from .. to; where
    that score is below 0, no score does.

    Rows whose id, label or vector is null, whose vector is empty or has a component that is null, NaN, infinite or no longer
    finite when scaled take no part; only vectors of one length are compared. Rows with the anchor's own id are no candidates of
    it; else repeated rows each count, as anchors, positives and negatives. Scores beyond 64 bits are cut to the nearest long.
    Other columns are ignored; an empty table gives an empty result.
    """
    low, high = window
    if not 0 <= low <= high <= 100 or positives < 1 or negatives < 1:
        raise ValueError("a window is two whole per cents in order, and at least one positive and one negative must be wanted")
    whole, fine = whole_components(F.col("v"), scale)
    base = df.select(df[id_col].cast("long").alias("id"), label.cast("long").alias("label"), df[vector_col].alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)).where(fine)
    rows = base.select("id", "label", "is_anchor", whole.alias("x")).withColumns({"r": F.monotonically_increasing_id(), "dim": F.size("x"), "norm": F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y))})
    rows = materialize(rows, "vectors")
    index = Index(rows)
    anchors = rows.where("is_anchor").select(F.col("r").alias("q"), "id", "label", "dim", "x", "norm")
    one = F.array(F.lit(None).cast("long"))
    near = _search(anchors.withColumns({"lo": one, "hi": one}), index, positives, same=True)
    # whole division first, so that no product leaves 64 bits
    hundreds = F.expr("score div 100 - if(score % 100 < 0, 1, 0)")
    near = near.withColumns({"from": hundreds * low + F.expr(f"({low} * pmod(score, 100) + 99) div 100"), "to": hundreds * high + F.expr(f"({high} * pmod(score, 100)) div 100")})
    windows = near.groupBy(F.col("q").alias("q2")).agg(F.sort_array(F.collect_list(F.struct("rank", "from", "to"))).alias("ws"))
    second = materialize(anchors.join(windows, F.col("q") == F.col("q2")).withColumns({"lo": F.col("ws.from"), "hi": F.col("ws.to")}).drop("q2", "ws"), "windows")
    hard = _search(second, index, negatives, same=False).select("q", (F.col("w") + 1).alias("place"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select(F.col("q").alias("q2"), F.col("rank").alias("r2"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pairs, (F.col("q") == F.col("q2")) & (F.col("place") == F.col("r2"))).join(anchors.select(F.col("q").alias("q3"), F.col("id").alias("anchor_id")), F.col("q") == F.col("q3"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
