"""Exact top-k search by inner product: one KD-tree for each shard of the vectors.

1. Equal vectors are put together: of each only the ids that can be among a query's k best stay, so that a crowd of equal
   vectors is no crowd of rows.
2. Space is cut into *cells* by median splits along the widest dimension, like the upper levels of a KD-tree. The
   splits are learned from at most SAMPLE_ROWS rows, but each row is put into its cell; a cell with more than ``shard_rows`` rows is
   dealt to several shards by a hash. Each shard's rows are the leaves of a KD-tree with a tight box at every node.
3. Queries are routed, not vectors: a query goes first to the cell whose box gives it the best bound, then, in waves of growing
   size, on to the next best cells, as long as their bounds reach its k-th best score so far. That score goes along with
   the query.
4. In a shard, a tree is walked best bound first: the most promising open node of each query is taken out, and its
   children are opened or its leaf is scored, until no open node's bound reaches the query's k-th score.

What is shuffled: each vector three times, a query once for each shard that its bounds leave open, and a tree once for every
QUERY_BLOCK queries that come to it. Only boxes of cells (MAX_CELLS at most for a length of vectors) go to all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

SHARD_ROWS = 8192
LEAF_ROWS = 128
#: Cells of the vectors of one length, at most; larger cells have several shards.
MAX_CELLS = 4096
#: Rows that the cells' borders are learned from, at most.
SAMPLE_ROWS = 32_768
#: Queries that are sent to one copy of a tree, on average.
QUERY_BLOCK = 4096
#: Queries that walk a tree together.
TOGETHER = 512
#: Cells that a query visits in a wave: one, then so many times more in each further wave.
WAVE = 4
#: Below it, sums of products are exact in double precision.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def build(ids: np.ndarray, x: np.ndarray, leaf_rows: int) -> dict:
    """A KD-tree over the rows of x. Nodes, the root first: tight box, children (0: a leaf), rows from .. to."""
    lo, hi, kids, rows = [], [], [], []
    order = np.arange(len(x))
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        part = x[order[a:b]]
        node = len(lo)
        lo.append(part.min(0)), hi.append(part.max(0)), kids.append([0, 0]), rows.append((a, b))
        if parent >= 0:
            kids[parent][side] = node
        spread = hi[node] - lo[node]
        if b - a > leaf_rows and spread.any():
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, int(spread.argmax())], mid)]
            todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
    return {"ids": ids[order], "x": x[order], "lo": np.stack(lo), "hi": np.stack(hi), "kids": np.array(kids), "rows": np.array(rows)}


def bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """[row of x, box]: the largest inner product that a vector in the box can have with the row."""
    return np.maximum(x, 0) @ hi.T + np.minimum(x, 0) @ lo.T


class Best:
    """The k best candidates of each query of a block, as good as ``kth`` or better: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k, self.kth = ids, x, k, kth.copy()
        self.q, self.s, self.v = np.empty(0, np.int64), np.empty(0, x.dtype), np.empty(0, np.int64)

    def add(self, q: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        q, s, v = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.v, v])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        full = rank == self.k - 1
        self.kth[q[full]] = np.maximum(self.kth[q[full]], s[full])
        self.q, self.s, self.v = q[top], s[top], v[top]

    def walk(self, tree: dict) -> int:
        """Best-first through the tree; returns how many nodes were taken out."""
        every, taken = np.arange(len(self.x)), 0
        never = -np.inf
        opened = np.full((len(self.x), len(tree["lo"])), never, self.x.dtype)
        opened[:, 0] = bounds(self.x, tree["lo"][:1], tree["hi"][:1])[:, 0]
        while True:
            node = opened.argmax(1)
            bound = opened[every, node]
            row = np.flatnonzero((bound > never) & (bound >= self.kth))  # an equal score may have a smaller id
            if not len(row):
                return taken
            taken += len(row)
            node = node[row]
            opened[row, node] = never
            by = np.argsort(node, kind="stable")
            row, node = row[by], node[by]
            cuts = np.flatnonzero(np.diff(node)) + 1
            found = []
            for rows, n in zip(np.split(row, cuts), node[np.r_[0, cuts]].tolist(), strict=True):
                kids = tree["kids"][n]
                if kids[0]:
                    opened[np.ix_(rows, kids)] = bounds(self.x[rows], tree["lo"][kids], tree["hi"][kids])
                    continue
                a, b = tree["rows"][n]
                score = self.x[rows] @ tree["x"][a:b].T
                if score.dtype == object:
                    score = np.minimum(np.maximum(score, LONG[0]), LONG[1])
                good = (score >= self.kth[rows][:, None]) & (tree["ids"][a:b][None] != self.ids[rows][:, None])
                i, j = np.nonzero(good)
                found.append((rows[i], score[i, j], tree["ids"][a:b][j]))
            if found:
                self.add(*map(np.concatenate, zip(*found, strict=True)))


def learn_splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of every split of a complete binary tree of a depth, in heap order; equal values go left."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = [x]
    for node in range(len(axis)):
        part = parts[node]
        if len(part):
            axis[node] = int((part.max(0) - part.min(0)).argmax())
            value[node] = np.partition(part[:, axis[node]], (len(part) - 1) // 2)[(len(part) - 1) // 2]
        left = part[:, axis[node]] <= value[node]
        parts += [part[left], part[~left]]
    return axis, value


def cell_of(x: np.ndarray, splits: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    if splits is None:
        return node
    axis, value = splits
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > value[node])
    return node - len(axis)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.array(col.flatten(), np.float64).reshape(-1, dim)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if len(x) and np.abs(x).max() < 1 << 15 else x


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among k best: of equal vectors those of the k + 1 smallest ids (one may be the query's own), k of each."""
    same = W.partitionBy("x", "id").orderBy("id")
    of_id = rows.select("id", "x", "dim").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k).drop("r")
    return of_id.withColumn("r", F.dense_rank().over(W.partitionBy("x").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for d in np.unique(dim).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dim == d)))


class Index:
    """Shards of the candidates: ``trees`` (dim, cell, sub, data), and for vectors of lengths with many rows, boxes of their cells."""

    def __init__(self, rows: DataFrame, k: int, shard_rows: int, leaf_rows: int) -> None:
        found = materialize(_distinct(rows, k), "vectors")
        many = {r["dim"]: r["count"] for r in found.groupBy("dim").count().where(F.col("count") > shard_rows).collect()}
        splits = {}
        for dim, n in many.items():
            depth = min((MAX_CELLS - 1).bit_length(), (-(-n // shard_rows) - 1).bit_length())
            share = F.pmod(F.xxhash64("x", "id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
            sample = found.where((F.col("dim") == dim) & share).select("x").limit(2 * SAMPLE_ROWS).toArrow()
            splits[dim] = learn_splits(_matrix(sample["x"].combine_chunks(), dim), depth)
        spread = found.sparkSession.sparkContext.broadcast(splits)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for d, b in _by_dim(whole):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(_matrix(b.column(1), d), spread.value.get(d)))], ["id", "x", "dim", "cell"])

        celled = materialize(small_batches(found.select("id", "x", "dim")).mapInArrow(assign, "id long, x array<double>, dim int, cell long"), "cells")
        subs = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("subs")).where("subs > 1").withColumnsRenamed({"dim": "d", "cell": "c"})
        dealt = celled.join(subs, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")), "left")
        dealt = dealt.select("id", "x", "dim", "cell", F.pmod(F.xxhash64("x", "id", F.lit(3)), F.coalesce("subs", F.lit(1))).alias("sub"))

        def plant(key: tuple, table: pa.Table) -> pa.Table:
            dim, cell, sub = (v.as_py() for v in key)
            ids, x = table["id"].to_numpy(), _matrix(table["x"].combine_chunks(), dim)
            order = np.argsort(ids, kind="stable")
            tree = build(ids[order], x[order], leaf_rows)
            box = [pa.array([tree[c][0].tolist()], pa.list_(pa.float64())) for c in ("lo", "hi")]
            data = pickle.dumps(tree | {c: _narrow(tree[c]) for c in ("x", "lo", "hi")})
            return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell]), "sub": pa.array([sub]), "data": pa.array([data], pa.binary()), "lo": box[0], "hi": box[1]})

        self.trees = materialize(dealt.groupBy("dim", "cell", "sub").applyInArrow(plant, "dim int, cell long, sub long, data binary, lo array<double>, hi array<double>"), "trees")
        discard(found, celled)
        self.boxes: dict[int, tuple] = {}
        for dim in many:  # shards of a cell have boxes of their own; what goes to all tasks is a box a cell
            lo, hi = (F.array(*(f(F.col(c)[i]) for i in range(dim))).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")))
            got = sorted(self.trees.where(F.col("dim") == dim).groupBy("cell").agg(lo, hi).collect())
            self.boxes[dim] = np.array([r["cell"] for r in got]), np.array([r["lo"] for r in got]), np.array([r["hi"] for r in got])
        self.cells = max([1, *(len(b[0]) for b in self.boxes.values())])


def _route(state: DataFrame, index: Index, first: int, after: int) -> DataFrame:
    """q, id, dim, x, kth, cell: queries and those of their best cells ``first`` .. ``after`` - 1 that may have something for them."""
    shared = state.sparkSession.sparkContext.broadcast(index.boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = shared.value
        for whole in batches:
            for d, b in _by_dim(whole):
                if d not in boxes:
                    row, cell = (np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)) if first == 0 else (np.empty(0, np.int64),) * 2
                else:
                    name, lo, hi = boxes[d]
                    x = _matrix(b.column(3), d)
                    bound = bounds(x, lo, hi)
                    bound += 1e-12 * bounds(np.abs(x), 0 * lo, np.maximum(np.abs(lo), np.abs(hi)))  # sums beyond 2^53 are rounded
                    best = np.argsort(-bound, axis=1, kind="stable")[:, first:after]
                    kth = b.column(4).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    row, at = np.nonzero(np.take_along_axis(bound, best, 1) >= kth[:, None] - 1e-12 * np.abs(np.where(np.isfinite(kth), kth, 0))[:, None])
                    cell = name[best[row, at]]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(cell)], ["q", "id", "dim", "x", "kth", "cell"])

    return small_batches(state.select("q", "id", "dim", "x", "kth")).mapInArrow(run, "q long, id long, dim int, x array<double>, kth long, cell long")


def _visit(routed: DataFrame, index: Index, k: int) -> DataFrame:
    """q, vec_id, score: what queries find in the shards of the cells they are routed to."""
    crowds = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("copies")).withColumnsRenamed({"dim": "d", "cell": "c"})
    on = (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))
    trees = index.trees.join(crowds, on).select("dim", "cell", "sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("long").alias("kth"), "data")
    subs = index.trees.groupBy("dim", "cell").agg(F.collect_list("sub").alias("subs")).withColumnsRenamed({"dim": "d", "cell": "c"})
    asked = routed.join(crowds.join(subs, ["d", "c"]), on).select("dim", "cell", F.explode("subs").alias("sub"), F.pmod(F.xxhash64("q"), F.col("copies")).alias("copy"), "q", "id", "x", "kth", F.lit(None).cast("binary").alias("data"))
    met = trees.unionByName(asked).repartition("dim", "cell", "sub", "copy").sortWithinPartitions("dim", "cell", "sub", "copy", F.col("q").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            q, x = rows["q"].to_numpy(), _matrix(rows["x"].combine_chunks(), rows["dim"][0].as_py())
            kth = rows["kth"].cast(pa.float64()).fill_null(-np.inf).to_numpy()
            item = tree | {c: tree[c].astype(np.float64) for c in ("x", "lo", "hi")}
            if x.shape[1] * max(np.abs(x).max(), 1) * max(np.abs(item["x"]).max(), 1) >= EXACT:  # whole numbers of any size
                x, kth = _whole(x), np.array([v if v is not None else -np.inf for v in rows["kth"].to_pylist()], object)
                item |= {c: _whole(item[c]) for c in ("x", "lo", "hi")}
            best = Best(rows["id"].to_numpy(), x, kth, k)
            best.walk(item)
            return pa.RecordBatch.from_arrays([pa.array(q[best.q], pa.int64()), pa.array(best.v, pa.int64()), pa.array([int(v) for v in best.s.tolist()], pa.int64())], ["q", "vec_id", "score"])

        tree, at, held = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            is_tree = batch.column(8).is_valid().to_pylist()
            i = 0
            while i < batch.num_rows:
                if held and (is_tree[i] or sum(b.num_rows for b in held) >= TOGETHER):
                    yield flush()
                    held = []
                if is_tree[i]:
                    tree, at, i = pickle.loads(batch.column(8)[i].as_py()), keys[i], i + 1
                    continue
                j = i
                while j < min(batch.num_rows, i + TOGETHER) and keys[j] == at and not is_tree[j]:
                    j += 1
                held.append(batch.slice(i, j - i).select([0, 4, 5, 6, 7]))
                i = j
        if held:
            yield flush()

    return small_batches(met.select("dim", "cell", "sub", "copy", "q", "id", "x", "kth", "data")).mapInArrow(search, "q long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For each query the k other rows with the highest integer inner product: query_id, rank (from 1), vec_id, score.

    Components x become floor(scale * x), x as double. Ties go to the smaller id. Rows whose id or vector is null, whose vector
    is empty or has a component that is null, NaN, infinite or no longer finite when scaled take no part; only vectors of one
    length are compared, those of a query's own. A query's own id is no candidate, so repeated rows of one id don't find each
    other; as candidates of others they each count. Scores beyond 64 bits are cut to the nearest long before they are
    compared. Other columns are ignored; an empty table gives an empty result.
    """
    scaled = F.transform(F.col("v"), lambda x: F.lit(float(scale)) * x.cast("double"))
    vector = F.transform("y", lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y))
    fine = F.col("id").isNotNull() & (F.size("y") > 0) & F.forall("y", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    base = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("v is not null")
    rows = base.select("id", scaled.alias("y"), "is_query").where(fine).select("id", vector.alias("x"), "is_query").withColumn("dim", F.size("x"))
    index = Index(rows, k, shard_rows, leaf_rows)
    # a query is known by a number of its own, since ids may repeat
    queries = materialize(rows.where("is_query").select(F.monotonically_increasing_id().alias("q"), "id", "dim", "x"), "queries")
    none = F.array().cast("array<struct<worse:bigint,vec_id:bigint>>")
    best = queries.select("q", F.lit(None).cast("long").alias("kth"), none.alias("top"))
    first, after = 0, 1
    while first < index.cells:
        state = queries.join(best.withColumnRenamed("q", "q2"), F.col("q") == F.col("q2"))
        routed = materialize(_route(state, index, first, after), "routed")
        if routed.isEmpty():
            break
        # the complement of a score sorts the other way round, without overflow
        found = _visit(routed, index, k).select("q", F.bitwise_not("score").alias("worse"), "vec_id").unionByName(best.select("q", F.inline("top")))
        top = F.slice(F.sort_array(F.collect_list(F.struct("worse", "vec_id"))), 1, k)
        best = found.groupBy("q").agg(top.alias("top")).select("q", F.when(F.size("top") == k, F.bitwise_not(F.element_at("top", -1)["worse"])).alias("kth"), "top")
        # who has found nothing yet goes on as well
        best = materialize(queries.select("q").join(best.withColumnRenamed("q", "q2"), F.col("q") == F.col("q2"), "left").select("q", "kth", F.coalesce("top", none).alias("top")), "best")
        first, after = after, after + (after - first) * WAVE
    found = best.select("q", F.inline("top")).join(queries.select(F.col("q").alias("q2"), F.col("id").alias("query_id")), F.col("q") == F.col("q2")).select("query_id", "vec_id", F.bitwise_not("worse").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
