"""Partitions of a tree's vertices: parts(vid, part)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.hashes import golden_hash
from ..storage import materialize
from . import ranges as rg
from .ends import with_ends
from .sequence import degrees, ranked
from .tree import with_last

METHODS = ("forward", "backward", "depth", "height", "naive")
BALANCE = 1.03


def capacity(total: int, k: int, balance: float = BALANCE) -> int:
    """What a part may weigh."""
    return kernels.capacity(total, k, balance)


def weighted(tree: DataFrame, vertex_weight: bool = False, edge_weight: bool = True, pre_weight: DataFrame | None = None) -> DataFrame:
    """tree(jnid, parent, weight): 1, the edges to later vertices, and with ``pre_weight`` (jnid, pre_weight) those from children's
    subtrees, as asked for."""
    t = tree.select("jnid", "parent", "pst_weight")
    weight = F.lit(int(vertex_weight)).cast("long") + (F.col("pst_weight") if edge_weight else F.lit(0))
    if pre_weight is not None:
        own = pre_weight.select("jnid", "pre_weight").join(t.select("jnid", "parent"), "jnid").where("parent is not null").groupBy(F.col("parent").alias("p2")).agg(F.sum("pre_weight").alias("pre"))
        t, weight = t.join(own, F.col("jnid") == F.col("p2"), "left"), weight + F.coalesce("pre", F.lit(0))
    return with_last(materialize(t.select("jnid", "parent", weight.alias("weight")), "weights"), tree)


def skeleton(t: DataFrame, cap: int) -> DataFrame:
    """The part of a tree(jnid, parent, weight) that packing decides on: vertices whose subtrees weigh more than ``cap``, their children and all
    roots: jnid, parent, weight, where the last two kinds weigh what their subtrees do. Nothing below can be cut off, since no subtree
    there is over the cap; it stays with the vertex that it hangs on.

    Heavy vertices are at most total / cap times the height of the tree.
    """
    below = rg.subtree_sums(with_last(t.withColumn("whole", F.col("weight")), t), ["whole"]).select("jnid", "whole")
    rows = materialize(t.join(below, "jnid"), "subtrees")
    heavy = rows.where(F.col("whole") > cap).select(F.col("jnid").alias("p2"))
    near = rows.join(heavy, F.col("parent") == F.col("p2"), "left")
    return near.where((F.col("whole") > cap) | F.col("p2").isNotNull() | F.col("parent").isNull()).select("jnid", "parent", F.when(F.col("whole") > cap, F.col("weight")).otherwise(F.col("whole")).alias("weight"))


def _packed(t: DataFrame, pack: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(jnid, part) of a few vertices, or of a tree of one range, by a kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            table = pa.Table.from_batches(held).sort_by("jnid")
            ids, up, _ = rg._above(table)
            part = pack(up, table["weight"].to_numpy()).astype(np.int64)
            yield from pa.table({"jnid": ids, "part": part}).to_batches(max_chunksize=1 << 16)

    return t.select("jnid", "parent", "weight").repartition(1).mapInArrow(run, "jnid long, part long")


def _handed_down(t: DataFrame, marked: DataFrame) -> DataFrame:
    """Every vertex takes the part of the nearest one in marked(jnid, part) on its way to the root."""
    rows = t.select("jnid", "parent").join(marked.select(F.col("jnid").alias("j2"), "part"), F.col("jnid") == F.col("j2"), "left").drop("j2")
    return rg.nearest_label(with_last(materialize(rows, "marked"), t), "part")


def cuts(weight: np.ndarray, cap: int, over: bool, before: int, since: int, begun: bool) -> tuple[list[int], int, bool]:
    """Rows at which new parts begin, the sum at which the last part began, and whether it has a row yet.

    ``before``: the sum of all earlier rows. A part's rows weigh under the cap without the last one, which reaches it; with ``over`` that row begins the next part
    instead, as whose first row it stays, whatever it weighs."""
    sums, found, k = before + np.cumsum(weight), [], 0
    while True:
        at = max(k, int(np.searchsorted(sums, since + cap)))
        if over:
            at = max(at, k if begun else k + 1)
        if at >= len(sums):
            return found, since, begun or k < len(sums)
        since = int(sums[at]) if not over else int(sums[at - 1]) if at else before
        k, begun = (at, False) if over else (at + 1, True)
        found.append(k)


def filled(t: DataFrame, order: list[str], cap: int, over: bool = False) -> DataFrame:
    """(jnid, part): rows with a ``weight`` fill part after part in an order, which must be one without ties; see ``cuts``.

    Rows are sorted into ranges and added up; a part's end is looked up in the one range where the sum reaches it, so there are at most as many look-ups as
    parts, each in a task of one range. The driver sees the sums of ranges and the ends of parts.
    """
    ranges = -(-t.count() // rg.RANGE_ROWS)
    put = materialize(t.repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order).select("jnid", "weight", F.monotonically_increasing_id().alias("id")), "ordered")
    put = put.withColumn("range", F.shiftrightunsigned("id", 33))
    rows, before, since, begun = 0, 0, 0, True
    starts, offset = [], {}
    for r in sorted(put.groupBy("range").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()):
        offset[r["range"]] = rows
        if cap > 0 and before + r["w"] >= since + cap:

            def run(batches: Iterator[pa.RecordBatch], before: int = before, since: int = since, begun: bool = begun) -> Iterator[pa.RecordBatch]:
                held = [b.column(0).to_numpy() for b in batches]
                found, since, begun = cuts(np.concatenate([np.empty(0, np.int64), *held]), cap, over, before, since, begun)
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.int64())), pa.array([since]), pa.array([begun])], ["found", "since", "begun"])

            one = put.where(F.col("range") == r["range"]).repartition(1).sortWithinPartitions("id").select("weight").mapInArrow(run, "found array<long>, since long, begun boolean")
            found, since, begun = one.where("since is not null").first()
            starts += [rows + k for k in found]
        else:
            begun = True
        rows, before = rows + r["n"], before + r["w"]
    at = F.col("id") - F.shiftleft("range", 33) + (F.element_at(F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)), F.col("range")) if offset else F.lit(0))
    placed = put.select("jnid", at.cast("long").alias("at"))
    if cap <= 0:  # each row is a part; the first one stays empty if rows don't end their parts
        return placed.select("jnid", (F.col("at") + int(over)).alias("part"))
    ends = np.array(starts, np.int64)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(ends, b.column(1).to_numpy(), "right"), pa.int64())], ["jnid", "part"])

    return placed.mapInArrow(name, "jnid long, part long")


def _forward(t: DataFrame, cap: int) -> DataFrame:
    if rg.range_count(t) <= 1:
        return _packed(t, lambda parent, weight: kernels.pack_forward(parent, weight, cap))
    return _handed_down(t, materialize(_packed(skeleton(t, cap), lambda parent, weight: kernels.pack_forward(parent, weight, cap)), "packed"))


def _backward(t: DataFrame, cap: int) -> DataFrame:
    """Along the way from the heaviest vertex down to its heaviest child and so on, parts are filled from below; all else takes the part of the
    nearest vertex above it on that way, or the last part."""
    if rg.range_count(t) <= 1:
        return _packed(t, lambda parent, weight: kernels.pack_critical(parent, weight, cap))
    below = rg.subtree_sums(with_last(t.withColumn("whole", F.col("weight")), t), ["whole"]).select("jnid", "whole")
    rows = materialize(t.select("jnid", "parent").join(below, "jnid"), "subtrees")
    heavier = F.struct(F.col("whole"), -F.col("jnid"))
    start = rows.agg(F.max_by("jnid", heavier)).first()[0]
    best = rows.where("parent is not null").groupBy(F.col("parent").alias("p2")).agg(F.max_by("jnid", heavier).alias("best"), F.max("whole").alias("best_whole"))
    best = materialize(best, "heaviest")
    linked = rows.join(best.select(F.col("best").alias("b2")), F.col("jnid") == F.col("b2"), "left")
    label = F.when(F.col("b2").isNull() | (F.col("jnid") == start), F.col("jnid"))
    ways = rg.nearest_label(with_last(materialize(linked.select("jnid", "parent", label.alias("label")), "links"), t), "label").where(F.col("label") == start).select("jnid")
    own = rows.join(ways, "jnid").join(best, F.col("jnid") == F.col("p2"), "left").select("jnid", (F.col("whole") - F.coalesce("best_whole", F.lit(0))).alias("weight"))
    way = materialize(filled(materialize(own, "way"), ["jnid"], cap, over=True), "way_parts")
    last = way.where(F.col("jnid") == start).first()["part"]
    return _handed_down(t, way).select("jnid", F.coalesce("part", F.lit(last)).alias("part"))


def _in_order(t: DataFrame, cap: int, method: str) -> DataFrame:
    if rg.range_count(t) <= 1:

        def pack(parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
            figures = kernels.path_figures(parent, weight)
            key = {"depth": -figures["depth"], "height": figures["height"], "naive": np.zeros(len(parent))}[method]
            return kernels.fill(np.argsort(key, kind="stable"), weight, cap)

        return _packed(t, pack)
    if method == "naive":
        return filled(t.select("jnid", "weight"), ["jnid"], cap)
    if method == "depth":
        key = rg.way_sums(with_last(t.withColumn("key", F.lit(-1).cast("long")), t), ["key"])
    else:
        key = rg.subtree_sums(with_last(t.withColumn("none", F.lit(0).cast("long")), t), ["none"]).select("jnid", F.col("height").alias("key"))
    return filled(materialize(t.select("jnid", "weight").join(key, "jnid"), "keys"), ["key", "jnid"], cap)


def tree_partition(tree: DataFrame, seq: DataFrame, k: int, method: str = "forward", balance: float = BALANCE, vertex_weight: bool = False, edge_weight: bool = True, pre_weight: DataFrame | None = None) -> DataFrame:
    """Cuts a tree into parts of at most floor(total / k) * balance: (vid, part). Weights: see ``weighted``. More than k parts may be needed.

    A tree of one range goes to one task whole, RANGE_ROWS vertices at most. Of a larger one a task sees a range, and with ``forward`` also
    the ``skeleton``, as bins are global.
    """
    if method not in METHODS or k < 1:
        raise ValueError(f"method must be one of {METHODS}, and k positive")
    t = weighted(tree, vertex_weight, edge_weight, pre_weight)
    total, most = t.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    cap = kernels.capacity(total, k, balance)
    if method == "forward" and most > cap:
        raise ValueError(f"a vertex weighs {most}, over the capacity {cap} of a part")
    parts = _forward(t, cap) if method == "forward" else _backward(t, cap) if method == "backward" else _in_order(t, cap, method)
    return parts.join(seq.withColumnRenamed("pos", "jnid"), "jnid").select("vid", F.col("part").cast("int").alias("part"))


def hash_partition(edges: DataFrame, k: int) -> DataFrame:
    """Every vertex to a part by its hash: the random baseline, but the same in each run."""
    return degrees(edges).select("vid", F.pmod(golden_hash(F.col("vid")), F.lit(k)).cast("int").alias("part"))


#: Rows of a sequential pass that one task takes, and bytes of a row of what it leaves to the next one.
PASS_ROWS = 1 << 22
_PIECE = 1 << 24


def in_sequence(df: DataFrame, order: list[str], kernel: object, schema: str) -> DataFrame:
    """A kernel that takes rows (longs, in an order) one after the other: ``take`` and ``finish`` return columns of ``schema``.

    Rows are sorted into ranges. PASS_ROWS of them at a time go to one task, which begins with the kernel as the task before left it, stored. The driver sees
    the counts of ranges."""
    names = df.columns
    put = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), *names)
    put = materialize(put, "ordered")  # ranges are sampled, so they are fixed before they are counted
    counts = sorted(put.groupBy(F.shiftrightunsigned("id", 33).alias("part")).count().collect())
    starts, left = [0], PASS_ROWS  # ids at which passes begin
    for part, n in counts:
        at = 0
        while n - at > left:
            at, left = at + left, PASS_ROWS
            starts.append((part << 33) + at)
        left -= n - at
    out, before = None, None
    for i, start in enumerate(starts):
        last = i + 1 == len(starts)
        here = F.col("id") >= start if last else (F.col("id") >= start) & (F.col("id") < starts[i + 1])
        rows = put.where(here).withColumn("state", F.lit(None).cast("binary"))
        if before is not None:
            rows = rows.unionByName(before.where("state is not null").select("id", "state"), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch], kernel: object = kernel, last: bool = last) -> Iterator[pa.RecordBatch]:
            pieces, fields = [], [f.split() for f in schema.split(", ")]
            types = {"long": pa.int64(), "int": pa.int32()}

            def done(columns: tuple) -> pa.RecordBatch:
                n = len(columns[0]) if columns else 0
                some = [pa.array(c).cast(types[t]) for c, (_, t) in zip(columns, fields, strict=True)] if columns else [pa.nulls(0, types[t]) for _, t in fields]
                return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *some], ["id", "state", *(c for c, _ in fields)])

            for batch in batches:
                is_state = batch.column(len(names) + 1).is_valid().to_numpy(zero_copy_only=False)
                if is_state.any():  # pieces come first
                    pieces += batch.column(len(names) + 1).filter(pa.array(is_state)).to_pylist()
                    batch = batch.filter(pa.array(~is_state))
                if pieces and batch.num_rows:
                    kernel, pieces = pickle.loads(b"".join(pieces)), []
                yield done(kernel.take(*(batch.column(c + 1).to_numpy() for c in range(len(names)))))
            if last:
                yield done(kernel.finish())
                return
            state = pickle.dumps(kernel)
            for k in range(0, len(state), _PIECE):
                one = [pa.array([k // _PIECE - (1 << 40)]), pa.array([state[k : k + _PIECE]], pa.binary())]
                yield pa.RecordBatch.from_arrays([*one, *(pa.nulls(1, types[t]) for _, t in fields)], ["id", "state", *(c for c, _ in fields)])

        before = materialize(rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, f"id long, state binary, {schema}"), "pass")
        found = before.where("state is null").drop("id", "state")
        out = found if out is None else out.unionByName(found)
    return out


def stream_vertices(edges: DataFrame, k: int, balance: float = BALANCE, by_edges: bool = True) -> DataFrame:
    """One pass over vertices by id; each joins the part with most of its neighbours, against the part's size."""
    degree = materialize(degrees(edges), "degrees")
    seq = ranked(degree, "vid")
    ends = with_ends(edges.select("src", "dst"), seq, 16).where("pos_x <> pos_y").select(F.greatest("pos_x", "pos_y").alias("pos"), F.least("pos_x", "pos_y").alias("near"))
    rows = ends.unionByName(seq.join(degree, "vid").select("pos", (-F.col("degree")).alias("near")))
    parts = in_sequence(rows, ["pos", "near"], kernels.VertexStream(seq._rows, edges.count(), k, balance, by_edges), "pos long, part int")
    return parts.join(seq, "pos").select("vid", "part")


def stream_edges(edges: DataFrame, k: int, balance: float = BALANCE) -> DataFrame:
    """One pass over edges in the order of their ends: (src, dst, part)."""
    seq = ranked(degrees(edges), "vid")
    rows = with_ends(edges.select("src", "dst"), seq, 16).select("pos_x", "pos_y", "src", "dst")
    return in_sequence(rows, ["pos_x", "pos_y"], kernels.EdgeStream(seq._rows, edges.count(), k, balance), "src long, dst long, part int")


def round_robin(edges: DataFrame, k: int) -> DataFrame:
    """Edge i, in the order of its ends, to part i mod k."""
    numbered = ranked(edges.select(F.struct("src", "dst").alias("vid"), "src", "dst"), "src", "dst")
    return numbered.select("vid.src", "vid.dst", (F.col("pos") % k).cast("int").alias("part"))
