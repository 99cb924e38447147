"""k-means by KD-tree filtering, in whole numbers.

1. Every partition of the vectors is cut into KD-trees of at most TREE_ROWS rows, where they lie: no shuffle. A node holds its tight
   box, its number of rows and their integer sums. Trees are written once and read by every round.
2. A round sends the centroids (k of them) to all trees and walks each from its root with a set of candidates. In a node, the
   candidate nearest to the middle of the box is the champion; another one goes if it is strictly farther than the champion
   even from the corner of the box that suits it best. A node with one candidate left is assigned as a whole, by its count and
   sums; in a leaf the candidates that are left are compared with every row. Ties stay until then, so they go to the smaller number.
3. What leaves a tree in a round is a count and sums for each cluster. Sums go in limbs of 32 bits, so they stay exact however many rows add
   up, and reach the driver as k rows a limb.

Memory of a task: one tree. Lost executors cost the trees or rows of their tasks; trees lie in the shared folder.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches
from .topk import EXACT, LONG, _matrix, _narrow, _whole, build

TREE_ROWS = 16_384
LEAF_ROWS = 64
#: Numbers that the differences between candidates may take at a time, in a walk.
BLOCK = 1 << 20
LIMB = 32


def whole_components(vector: Column, scale: float) -> tuple[Column, Column]:
    """floor(scale * x) of every component as doubles that are whole numbers, and whether all of them are there and finite."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return F.transform(scaled, lambda y: F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)), fine


def plant(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """A KD-tree over rows of whole numbers: boxes, children, rows from .. to, their sums, and the order that rows were put in."""
    tree = build(np.arange(len(x)), x, leaf_rows)
    rows = tree["x"] if np.abs(x).max() * len(x) < EXACT else _whole(tree["x"])
    ends = np.concatenate([np.zeros((1, x.shape[1]), rows.dtype), np.cumsum(rows, axis=0)])
    tree["sums"] = ends[tree["rows"][:, 1]] - ends[tree["rows"][:, 0]]
    tree["order"] = tree.pop("ids")
    return tree


def _exact(tree: dict, centroids: list[tuple[int, ...]]) -> tuple[dict, np.ndarray]:
    """Both in double precision where all results are below 2^53, else as Python's whole numbers."""
    c = np.array(centroids, object)
    most = max(int(abs(tree["lo"][0]).max()), int(abs(tree["hi"][0]).max()), int(abs(c).max()), 1)
    if 4 * c.shape[1] * most * most < EXACT and most * len(tree["x"]) < EXACT:
        return tree | {k: tree[k].astype(np.float64) for k in ("x", "lo", "hi", "sums")}, c.astype(np.float64)
    return tree | {k: _whole(tree[k]) for k in ("x", "lo", "hi", "sums")}, c


def walk(tree: dict, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that are assigned as a whole and their clusters; rows that are assigned one by one and theirs."""
    square = (c * c).sum(1)
    nodes, alive = np.array([0]), np.ones((1, len(c)), bool)
    whole, of_whole, leaves, left = [], [], [], []
    step = max(1, BLOCK // c.size)
    while len(nodes):
        again, still = [], []
        for k in range(0, len(nodes), step):
            node, able = nodes[k : k + step], alive[k : k + step]
            lo, hi = tree["lo"][node], tree["hi"][node]
            far = square[None] - (lo + hi) @ c.T
            best = np.where(able, far, far.max() + 1).argmin(1)
            apart = c[None] - c[best][:, None]
            reach = (np.maximum(apart, 0) * hi[:, None]).sum(-1) + (np.minimum(apart, 0) * lo[:, None]).sum(-1)
            able = able & ~np.asarray(square[None] - square[best][:, None] - 2 * reach > 0, bool)
            one, leaf = able.sum(1) == 1, tree["kids"][node, 0] == 0
            whole.append(node[one])
            of_whole.append(best[one])
            leaves.append(node[~one & leaf])
            left.append(able[~one & leaf])
            deeper = ~one & ~leaf
            again.append(tree["kids"][node[deeper]].ravel())
            still.append(np.repeat(able[deeper], 2, axis=0))
        nodes, alive = np.concatenate(again), np.concatenate(still)
    leaves, left = np.concatenate(leaves), np.concatenate(left)
    rows, own = [], []
    for node, able in zip(leaves.tolist(), left, strict=True):
        a, b = tree["rows"][node]
        some = np.flatnonzero(able)
        rows.append(np.arange(a, b))
        own.append(some[(square[some][None] - 2 * (tree["x"][a:b] @ c[some].T)).argmin(1)])
    none = np.empty(0, np.int64)
    return np.concatenate(whole), np.concatenate(of_whole), np.concatenate([none, *rows]), np.concatenate([none, *own])


def _limbs(v: np.ndarray) -> Iterator[np.ndarray]:
    """Whole numbers as limbs of 32 bits, the lowest first; the last one has the sign."""
    v = v.astype(np.int64) if v.dtype != object else v
    while bool((abs(v) >> (LIMB - 1)).any()):
        yield v & ((1 << LIMB) - 1)
        v = v >> LIMB
    yield v


def _trees(rows: DataFrame, dim: int, tree_rows: int) -> DataFrame:
    """(id, x) -> trees of at most ``tree_rows`` rows, made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            held = pa.Table.from_batches(waiting)
            tree = plant(_matrix(held["x"].combine_chunks(), dim))
            ids = held["id"].combine_chunks().take(pa.array(tree.pop("order")))
            tree |= {k: _narrow(tree[k]) for k in ("x", "lo", "hi")} | {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "no_id": ids.is_null().to_numpy(zero_copy_only=False)}
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], ["tree"])

        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, tree_rows - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == tree_rows:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    return small_batches(rows).mapInArrow(run, "tree binary")


def _sums(trees: DataFrame, centroids: list[tuple[int, ...]]) -> dict[int, tuple[int, list[int]]]:
    """cluster -> its number of rows and their sums, by a walk through every tree."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                tree, c = _exact(pickle.loads(data), centroids)
                node, of_node, row, of_row = walk(tree, c)
                size = np.diff(tree["rows"], axis=1)[:, 0]
                out = []
                for k in np.union1d(of_node, of_row).tolist():
                    mine, rows = node[of_node == k], row[of_row == k]
                    total = tree["sums"][mine].sum(0) + tree["x"][rows].sum(0)
                    for at, limb in enumerate(_limbs(total)):
                        out.append((k, at, 0 if at else int(size[mine].sum()) + len(rows), limb.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["cluster", "limb", "n", "s"])

    added = trees.mapInArrow(run, "cluster int, limb int, n long, s array<long>").groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dim))).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # k rows a limb
        n, s = out.get(r["cluster"], (0, [0] * dim))
        out[r["cluster"]] = n + r["n"], [x + (y << (LIMB * r["limb"])) for x, y in zip(s, r["s"], strict=True)]
    return out


def _assigned(trees: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """vec_id, cluster, distance of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                tree, c = _exact(pickle.loads(data), centroids)
                node, of_node, row, of_row = walk(tree, c)
                cluster = np.empty(len(tree["x"]), np.int32)
                cluster[row] = of_row
                for (a, b), k in zip(tree["rows"][node].tolist(), of_node.tolist(), strict=True):
                    cluster[a:b] = k
                apart = tree["x"] - c[cluster]
                distance = np.minimum((apart * apart).sum(1), LONG[1]) if apart.dtype == object else (apart * apart).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64(), mask=tree["no_id"]), pa.array(cluster), pa.array(distance.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly ``dim`` components, none null or non-finite, also when scaled, take part; each component x becomes
    floor(scale * x). Centroids start as the k vectors whose ids have the smallest sha256 of "seed:id"; repeated ids come in the order
    of their vectors, and a null id comes last. With fewer than k vectors there are as many centroids. Each of ``rounds``
    rounds assigns every vector to the nearest centroid (ties: smaller number) and replaces each centroid that has vectors by the floors of
    their means. A row for each row that takes part, null and repeated ids included; distances and inertias beyond 64 bits are cut to
    the largest long. Other columns are ignored; an empty table gives an empty result.
    """
    whole, fine = whole_components(F.col("v"), scale)
    base = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).where(F.size("v") == dim)
    rows = base.where(fine).select("id", whole.alias("x"))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [tuple(int(y) for y in r["x"]) for r in first]
    trees = materialize(_trees(rows, dim, tree_rows), "kd_trees")
    for _ in range(rounds):
        added = _sums(trees, centroids)
        centroids = [tuple(y // added[j][0] for y in added[j][1]) if j in added else c for j, c in enumerate(centroids)]
    out = materialize(_assigned(trees, centroids), "clusters")
    discard(trees)
    spent = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    cut = lambda x: F.lit(min(x, LONG[1])).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return out.select("vec_id", "cluster", "distance", of([cut(spent.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"), cut(sum(spent.values())).alias("inertia"), of(digests).alias("centroid_sha256"))
