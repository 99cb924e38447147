"""Elimination trees: tree(jnid, parent, pst_weight), jnid being the position of a vertex in its sequence.

``parent`` of v is the first later vertex that v reaches through vertices up to itself. Trees of parts of the edges merge: the
tree of the union of two forests' edges is the tree of both, so partial forests shrink every partition to fewer rows than
vertices before they meet, and weights are plain sums.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.kernels import NONE
from ..storage import fits_broadcast, materialize
from . import ranges as rg
from .ends import with_ends
from .limits import width_limited
from .sequence import ranked

def positioned(edges: DataFrame, seq: DataFrame) -> DataFrame:
    """epos(lo, hi): positions of the ends of each edge; loops go. Vertices that the sequence omits come after all others:
    their end is null, and an edge between two of them belongs to no tree."""
    e = with_ends(edges.select("src", "dst").where("src <> dst"), seq, 16).select(F.col("pos_x").alias("p"), F.col("pos_y").alias("q")).where("p is not null or q is not null")
    return e.select(F.least("p", "q").alias("lo"), F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.greatest("p", "q")).alias("hi"))


def pst_weight(epos: DataFrame) -> DataFrame:
    """Edges from each vertex to later ones, with multiplicity."""
    return epos.groupBy(F.col("lo").alias("jnid")).agg(F.count("*").alias("pst_weight"))


def pst_lists(edges: DataFrame, seq: DataFrame) -> DataFrame:
    """jnid and the sorted distinct ids of its later neighbours."""
    e = with_ends(edges.select("src", "dst").where("src <> dst"), seq, 16)
    both = e.select(F.explode(F.array(F.struct(F.col("pos_x").alias("jnid"), F.col("pos_y").alias("other"), F.col("dst").alias("near")), F.struct(F.col("pos_y").alias("jnid"), F.col("pos_x").alias("other"), F.col("src").alias("near")))).alias("e")).select("e.*")
    return both.where("jnid is not null and (other is null or other > jnid)").groupBy("jnid").agg(F.array_sort(F.collect_set("near")).alias("pst"))


#: Edges for later ranges that a task holds, in ranges, and rows of a batch that it sends.
SENT_RANGES = 8
_AT_ONCE = 1 << 15


def _forest_of(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The forest of edges in the order of hi, and the sum of w for each lo, in one row a vertex."""
    v = np.concatenate([lo, hi])
    v.sort()
    v = v[np.r_[True, v[1:] != v[:-1]]]
    x = np.searchsorted(v, lo).astype(np.int32)
    new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] & (hi != NONE)
    parent = np.frombuffer(kernels.forest(x[new], np.searchsorted(v, hi[new]).astype(np.int32), len(v)), np.int32)
    weight = np.zeros(len(v), np.int64)
    np.add.at(weight, x, w)
    named = np.zeros(len(v), bool)
    named[x] = True  # every vertex with a parent is the lower end of an edge or has one below it
    named |= parent != NONE
    some = np.flatnonzero(named)
    for k in range(0, len(some), _AT_ONCE):
        rows = some[k : k + _AT_ONCE]
        up = parent[rows]
        yield pa.RecordBatch.from_arrays([pa.array(v[rows]), pa.array(v[np.maximum(up, 0)], mask=up == NONE), pa.array(weight[rows])], ["lo", "hi", "w"])


def _forests(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lo, hi, w) in the order of hi -> the forests of so many of them at a time: a partition may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty((3, rows), np.int64), 0
        for b in batches:
            cols = [b.column(c).fill_null(NONE).to_numpy(zero_copy_only=False) for c in range(3)]
            a = 0
            while a < b.num_rows:
                m = min(rows - n, b.num_rows - a)
                held[:, n : n + m] = [c[a : a + m] for c in cols]
                a, n = a + m, n + m
                if n == rows:
                    yield from _forest_of(*held)
                    n = 0
        if n:
            yield from _forest_of(*held[:, :n])

    return run


def partial_forests(rows: DataFrame) -> DataFrame:
    """(lo, hi, w) -> the forests of each partition's edges, 2 * RANGE_ROWS at a time, with the sums of w, a row for each of their vertices.

    A row without hi has only a weight."""
    return rows.select("lo", "hi", "w").sortWithinPartitions("hi", "lo").mapInArrow(_forests(2 * rg.RANGE_ROWS), "lo long, hi long, w long")


class _Sent:
    """Edges for later ranges, of which only a forest is sent: one that stays below half of ``most`` rows takes in all further edges, a larger one is sent at once.

    An edge is held as one number, its ends' distances from ``base``, and the forest takes the edges' place; edges too far away for that are sent as they are."""

    def __init__(self, most: int, base: int = 0) -> None:
        self.most, self.base, self.rows, self.is_forest = most, base, 0, True
        self.held = np.empty(0, np.int64)

    def add(self, lo: list[int], hi: list[int]) -> Iterator[pa.RecordBatch]:
        lo, hi = (np.asarray(x, np.int64) - self.base for x in (lo, hi))
        near = hi < kernels.FAR
        if not near.all():
            yield self._batch(lo[~near], hi[~near])
            lo, hi = lo[near], hi[near]
        if not len(lo):
            return
        end = self.rows + len(lo)
        if end > len(self.held):
            room = np.empty(max(end, self.most + _AT_ONCE), np.int64)
            room[: self.rows] = self.held[: self.rows]
            self.held = room
        self.held[self.rows : end] = kernels.pairs(lo, hi)
        self.rows, self.is_forest = end, False
        if self.rows >= self.most:
            self._shrink()
            if 2 * self.rows > self.most:
                yield from self.rest()

    def _shrink(self) -> None:
        self.rows, self.is_forest = kernels.shrink(self.held[: self.rows]), True

    def _batch(self, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lo + self.base), pa.array(hi + self.base), pa.array(np.zeros(len(lo), np.int64)), pa.array(np.zeros(len(lo), bool))], ["lo", "hi", "w", "done"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.is_forest:
            self._shrink()
        for k in range(0, self.rows, _AT_ONCE):
            yield self._batch(*kernels.ends(self.held[k : min(k + _AT_ONCE, self.rows)]))
        self.__init__(self.most, self.base)


def _in_its_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, lo, hi, w, size) in the order of range and hi -> what is known of each vertex of a range, done, and edges for later ranges.

    Edges within the range make its forest first, as they come first. Then each component meets later vertices in their order: the first is its
    root's parent, and each further one is an edge from the one before, which is how they will be joined above it. These edges meet in a few late
    ranges, so only their forest is sent. A range is held in arrays, and SENT_RANGES times as many edges."""
    at, base, size, sent = None, 0, 0, _Sent(0)
    up, last = array("q"), array("q")  # by place in the range: a way to the top, and the last later vertex met
    parent, weight, named = (np.empty(0, t) for t in (np.int64, np.int64, bool))

    def flush() -> pa.RecordBatch:
        some = np.flatnonzero(named | (parent != NONE))
        to = parent[some]
        return pa.RecordBatch.from_arrays([pa.array(some + base), pa.array(to, mask=to == NONE), pa.array(weight[some]), pa.array(np.ones(len(some), bool))], ["lo", "hi", "w", "done"])

    for whole in batches:
        own = whole.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            batch = whole.slice(a, b - a)
            if own[a] != at:
                if at is not None:
                    yield from sent.rest()
                    yield flush()
                at, size = own[a], int(batch.column(4)[0].as_py())
                base = int(at) * size
                sent = _Sent(SENT_RANGES * size, base)
                up, last = array("q", range(size)), array("q", [NONE]) * size
                parent, weight, named = np.full(size, NONE), np.zeros(size, np.int64), np.zeros(size, bool)
            lo, hi, w = (batch.column(c).fill_null(NONE).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            place = lo - base
            named[place] = True
            np.add.at(weight, place, w)
            new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] & (hi != NONE)
            inside = new & (hi < base + size)
            for v, y in zip(place[inside].tolist(), (hi[inside] - base).tolist(), strict=True):
                while (n := up[v]) != v:
                    up[v] = v = up[n]
                if v != y:
                    up[v] = y
                    parent[v] = y + base
            x, y = [], []
            for v, to in zip(place[new & ~inside].tolist(), hi[new & ~inside].tolist(), strict=True):
                while (n := up[v]) != v:
                    up[v] = v = up[n]
                before = last[v]
                if before == NONE:
                    parent[v] = to
                elif before != to:
                    x.append(before)
                    y.append(to)
                last[v] = to
            if x:
                yield from sent.add(x, y)
    if at is not None:
        yield from sent.rest()
        yield flush()


def reduce_forests(forests: DataFrame, last: int) -> DataFrame:
    """Joins partial forests over positions up to ``last``: jnid, parent, w.

    Each range of positions has a task, which holds its vertices alone. It settles them as far as its edges say, and sends on what
    its components mean for later ranges. Ranges that get new edges run again, with what they knew; as edges only lead to later ranges, the first
    is settled after one round, and there are never more rounds than ranges.
    """
    size, ranges = rg.RANGE_ROWS, last // rg.RANGE_ROWS + 1

    def settle(rows: DataFrame) -> DataFrame:
        put = rows.select(rg.range_of("lo").alias("range"), "lo", "hi", "w", F.lit(size).cast("long").alias("size"))
        put = put.repartitionById(ranges, F.col("range").cast("int"))  # a range a task: hashes would put several into one
        return put.sortWithinPartitions("range", F.col("hi").asc_nulls_first(), "lo").mapInArrow(_in_its_range, "lo long, hi long, w long, done boolean")

    if ranges <= 1:
        return settle(forests).select(F.col("lo").alias("jnid"), F.col("hi").alias("parent"), "w")
    tables = [materialize(settle(forests), "ranges")]
    of = dict.fromkeys(range(ranges), 0)  # the table with the latest state of each range
    while active := [r[0] for r in tables[-1].where("not done").select(rg.range_of("lo")).distinct().collect()]:  # a number a range
        sent, known = tables[-1].where("not done"), {}
        for r in active:
            known.setdefault(of[r], []).append(r)
        rows = sent.select("lo", "hi", "w")
        for k, some in known.items():
            rows = rows.unionByName(tables[k].where("done").where(rg.range_of("lo").isin(some)).select("lo", "hi", "w"))
        tables.append(materialize(settle(rows), "ranges"))
        of |= dict.fromkeys(active, len(tables) - 1)
    held = [(t, [r for r, k in of.items() if k == i]) for i, t in enumerate(tables)]
    out = None
    for t, some in held:
        if some:
            part = t.where("done").where(rg.range_of("lo").isin(some)).select(F.col("lo").alias("jnid"), F.col("hi").alias("parent"), "w")
            out = part if out is None else out.unionByName(part)
    return out


def build_tree(epos: DataFrame, seq: DataFrame) -> DataFrame:
    """tree(jnid, parent, pst_weight) with a node for every vertex of the sequence, also one without edges.

    Edges are read once: each partition shrinks to its forest and the weights of its vertices, which are joined range by range.
    """
    return attach(reduce_forests(partial_forests(epos.select("lo", "hi", F.lit(1).cast("long").alias("w"))), last_position(seq)), seq)


def last_position(seq: DataFrame) -> int:
    """The number of vertices less 1, which ``ranked`` knows of the sequences that it makes."""
    rows = getattr(seq, "_rows", None)
    return (seq.count() if rows is None else rows) - 1


def attach(reduced: DataFrame, seq: DataFrame) -> DataFrame:
    t = seq.select(F.col("pos").alias("jnid")).join(reduced, "jnid", "left")
    return t.select("jnid", "parent", F.coalesce("w", F.lit(0)).alias("pst_weight"))


def merge_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """The tree of both graphs' edges, from their trees over one sequence."""
    both = left.select("jnid", "parent", "pst_weight").unionByName(right.select("jnid", "parent", "pst_weight"))
    last = both.agg(F.max("jnid")).first()[0]
    reduced = reduce_forests(partial_forests(both.select(F.col("jnid").alias("lo"), F.col("parent").alias("hi"), F.col("pst_weight").alias("w"))), -1 if last is None else last)
    return attach(reduced, both.select(F.col("jnid").alias("pos")).distinct())


def kids(tree: DataFrame) -> DataFrame:
    """Nodes with children, and these in order."""
    return tree.where("parent is not null").groupBy(F.col("parent").alias("jnid")).agg(F.sort_array(F.collect_list("jnid")).alias("kids"))


def prefix(tree: DataFrame, size: int) -> DataFrame:
    """The first nodes of a tree; parents beyond are cut."""
    return tree.where(F.col("jnid") < size).withColumn("parent", F.when(F.col("parent") < size, F.col("parent")))


def in_one_task(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A sequential kernel over all rows of a tree: O(vertices) memory in one task, as the figures depend on each other."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            out = run(pa.Table.from_batches(held).to_pandas(integer_object_nulls=True))
            yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()

    return df.repartition(1).mapInArrow(whole, schema)


def arrays(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorts a tree's rows by jnid in place; its ids and its parents as row numbers."""
    t.sort_values("jnid", inplace=True, ignore_index=True)
    ids = t["jnid"].to_numpy(np.int64)
    parent = np.array([NONE if p is None or p != p else p for p in t["parent"]], np.int64)
    return ids, np.where(parent == NONE, NONE, np.searchsorted(ids, parent))


def path_figures(tree: DataFrame) -> DataFrame:
    """jnid, depth, path_weight (to the root, itself included), height, subtree_size, subtree_weight, enter (a subtree's vertices have
    the subtree_size numbers from its root's on; later children and roots come first).

    A tree of one range is worked out by one task, which holds RANGE_ROWS vertices at most; a larger one range by range: subtrees first,
    then what siblings with smaller numbers take, then sums along the ways to the roots.
    """
    names = "jnid long, depth long, path_weight long, height long, subtree_size long, subtree_weight long, enter long"
    if rg.range_count(tree) <= 1:

        def run(t: pd.DataFrame) -> pd.DataFrame:
            ids, parent = arrays(t)
            return pd.DataFrame({"jnid": ids} | kernels.path_figures(parent, t["pst_weight"].to_numpy(np.int64)))

        return in_one_task(tree.select("jnid", "parent", "pst_weight"), run, names)
    one = F.lit(1).cast("long")
    below = rg.subtree_sums(with_last(tree.select("jnid", "parent", F.col("pst_weight").alias("subtree_weight"), one.alias("subtree_size")), tree), ["subtree_weight", "subtree_size"])
    below = materialize(tree.select("jnid", "parent", "pst_weight").join(below, "jnid").withColumn("range", rg.range_of("jnid")), "subtrees")
    # siblings, later ones first, are added up range by range and then within each, so a vertex may have any number of children
    blocks = below.groupBy("parent", "range").agg(F.sum("subtree_size").alias("n")).withColumn("ahead", F.sum("n").over(W.partitionBy("parent").orderBy(F.desc("range"))) - F.col("n"))
    blocks = blocks.select(F.col("parent").alias("p2"), F.col("range").alias("r2"), "ahead")
    near = F.sum("subtree_size").over(W.partitionBy("parent", "range").orderBy(F.desc("jnid")).rowsBetween(W.unboundedPreceding, -1))
    own = below.withColumn("near", F.coalesce(near, F.lit(0))).join(blocks, F.col("parent").eqNullSafe(F.col("p2")) & (F.col("range") == F.col("r2")))
    nested = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")
    own = materialize(own.select("jnid", "parent", F.col("pst_weight").alias("path_weight"), nested.alias("depth"), (F.col("near") + F.col("ahead") + nested).alias("enter")), "places")
    ways = rg.way_sums(with_last(own, tree), ["depth", "path_weight", "enter"])
    return ways.join(below.select("jnid", "height", "subtree_size", "subtree_weight"), "jnid").select(*(c.split()[0] for c in names.split(", ")))


def with_last(df: DataFrame, tree: DataFrame) -> DataFrame:
    """``df``, which has the ids of a tree: the last one needn't be looked for again."""
    df._last_id = rg.last_id(tree)
    return df


def _tour(tree: DataFrame) -> DataFrame:
    """tour(jnid, parent, enter, up), stored, ``up`` being the parent's ``enter``."""
    figures = materialize(path_figures(tree).select("jnid", "enter"), "enter")
    parent = tree.select("jnid", "parent").join(figures, "jnid").join(figures.select(F.col("jnid").alias("parent"), F.col("enter").alias("up")), "parent", "left")
    return materialize(parent.select("jnid", "parent", "enter", "up"), "tour")


def _neighbourhoods(tree: DataFrame, epos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tour(jnid, parent, enter, up); met(i, enter, ...), each vertex and its earlier neighbours; and (i, before, enter), each
    of these with the one before it in the order of ``enter``, in which i comes first. A neighbourhood is ordered block by block."""
    tour = _tour(tree)
    edges = epos.where("hi is not null").select("lo", "hi").distinct()
    met = edges.join(tour.select(F.col("jnid").alias("lo"), "enter"), "lo").select(F.col("hi").alias("i"), "enter").unionByName(tour.select(F.col("jnid").alias("i"), "enter"))
    met = materialize(met.withColumn("block", F.expr(f"enter div {rg.RANGE_ROWS}")), "met")
    near = met.withColumn("before", F.lag("enter").over(W.partitionBy("i", "block").orderBy("enter"))).where("before is not null").select("i", "before", "enter")
    if rg.range_count(tree) > 1:
        ends = met.groupBy("i", "block").agg(F.min("enter").alias("enter"), F.max("enter").alias("most"))
        near = near.unionByName(ends.withColumn("before", F.lag("most").over(W.partitionBy("i").orderBy("block"))).where("before is not null").select("i", "before", "enter"))
    return tour, met, near


def widths(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """jnid, width: 1 + the number of later neighbours in the filled graph, without making that graph.

    The vertices that have i as a later neighbour there, and i itself, are the ways from i's earlier neighbours up to i. In the order
    of ``enter`` each neighbour's way meets that of the one before it at their lowest common ancestor: so 1 for i and each
    neighbour, less 1 for each such meeting and for i's parent, add up to 1 over the subtree of each vertex on the ways and to 0 elsewhere.
    A meeting's ``enter`` is the least ``enter`` of a parent among the vertices after the one up to the other.
    Rows are as many as edges and vertices; a neighbourhood is ordered block by block, so a vertex may have any number of them.
    """
    tour, met, near = _neighbourhoods(tree, epos)
    figures = tour.select("jnid", "enter")
    pairs = near.groupBy((F.col("before") + 1).alias("a"), F.col("enter").alias("b")).agg(F.count("*").alias("n"))
    meetings = least_of(tour.select(F.col("enter").alias("at"), F.col("up").alias("value")), pairs)
    gains = met.groupBy("enter").agg(F.count("*").alias("d"))
    losses = meetings.select(F.col("least").alias("enter"), (-F.col("n")).alias("d")).unionByName(tour.where("up is not null").select(F.col("up").alias("enter"), F.lit(-1).cast("long").alias("d")))
    change = gains.unionByName(losses).groupBy("enter").agg(F.sum("d").alias("width"))
    rows = tree.select("jnid", "parent").join(figures, "jnid").join(change, "enter").select("jnid", "parent", "width")
    return rg.subtree_sums(with_last(rows, tree), ["width"]).select("jnid", "width")


#: Questions that one task answers, about.
ASKED_ROWS = 1 << 20


def dealt(lines: DataFrame, asked: DataFrame, cells: int, by: list[str], at_once: int = 1, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of lines and asked, both (cell, a, ...) with null ``a`` in lines: those of a cell in one task, or, if it is asked more than ``at_once`` times ASKED_ROWS times, its
    lines in each of several tasks and its questions dealt out among them. Lines come first, questions in the order asked for."""
    often = dict(asked.groupBy("cell").count().collect())  # a number a cell
    shares = {k: max(1, -(-often.get(k, 0) // (at_once * ASKED_ROWS))) for k in range(cells)}
    first = dict(zip(shares, np.cumsum([0, *shares.values()]).tolist(), strict=False))
    table = lines.sparkSession.createDataFrame([(k, first[k], n) for k, n in shares.items()] or [(0, 0, 1)], "k long, first long, shares long")
    share = lambda df: df.join(F.broadcast(table), F.col("cell") == F.col("k"))
    every = share(lines).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    some = share(asked).withColumn("share", F.pmod(F.xxhash64(*by), F.col("shares")))
    rows = every.unionByName(some).withColumn("task", (F.col("first") + F.col("share")).cast("int"))
    return rows.repartitionById(max(1, sum(shares.values())), "task").sortWithinPartitions(F.col("a").isNotNull(), *order).select(*asked.columns)


def least_of(line: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n) with the least ``value`` of line(at, value) at a .. b: a, b, n, least. ``at`` are whole numbers from 0, each once; null values count as none. Each (a, b, n) comes once.

    A task holds a block of the line, and the least values of all blocks, one a block; pairs stream past it. A pair that reaches
    over several blocks is asked in the first and the last one, and the blocks between are looked up on the way. A block that is
    asked more than ASKED_ROWS times goes to several tasks, among which the pairs are dealt out.
    """
    size = rg.RANGE_ROWS
    blocks = dict(line.groupBy(F.expr(f"at div {size}")).agg(F.min("value")).collect())
    count = max(blocks, default=-1) + 1
    most = np.iinfo(np.int64).max
    whole = np.array([most if blocks.get(k) is None else blocks[k] for k in range(count)], np.int64)
    cell = lambda c: F.expr(f"{c} div {size}")
    pairs = materialize(pairs.select("a", "b", "n"), "pairs")  # counted, and asked twice
    asked = pairs.select(cell("a").alias("cell"), "a", "b", "n")
    if count > 1:
        asked = asked.unionByName(pairs.where(cell("a") < cell("b")).select(cell("b").alias("cell"), "a", "b", "n"))
    none = F.lit(None).cast("long")
    lines = line.select(cell("at").alias("cell"), none.alias("a"), F.col("at").alias("b"), F.col("value").alias("n"))
    rows = dealt(lines, asked, count, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = kernels.Least(whole)
        at, values, table = None, None, None
        for batch in batches:
            own, is_line = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(is_line.astype(np.int8)) != 0)) + 1).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if own[i] != at:
                    at, values, table = own[i], np.full(size, most, np.int64), None
                a, b, n = (part.column(c) for c in (1, 2, 3))
                if is_line[i]:
                    values[b.to_numpy() - at * size] = n.fill_null(most).to_numpy(zero_copy_only=False)
                    continue
                if table is None:
                    table = kernels.Least(values)
                x, y = a.to_numpy(), b.to_numpy()
                least = np.minimum(table.least(np.maximum(x - at * size, 0), np.minimum(y - at * size, size - 1)), between.least(x // size + 1, y // size - 1))
                yield pa.RecordBatch.from_arrays([a, b, n, pa.array(least)], ["a", "b", "n", "least"])

    found = rows.mapInArrow(run, "a long, b long, n long, least long")
    return found if count <= 1 else found.groupBy("a", "b", "n").agg(F.min("least").alias("least"))


def pre_weights(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """jnid, pre_weight: edges from a vertex's subtree to its parent.

    Both ends of an edge lie on one way to the root, so it belongs to the child of its later end below which the earlier one is: of the
    children in the order of their numbers the last one that begins at or before it.
    """
    enter = materialize(path_figures(tree).select("jnid", "enter"), "enter")
    e = epos.where("hi is not null").groupBy("lo", "hi").agg(F.count("*").alias("n"))
    ends = e.join(enter.withColumnRenamed("jnid", "lo"), "lo").select(F.col("hi").alias("at"), "enter", F.lit(None).cast("long").alias("kid"), "n")
    kids_ = tree.where("parent is not null").join(enter, "jnid").select(F.col("parent").alias("at"), "enter", F.col("jnid").alias("kid"), F.lit(0).cast("long").alias("n"))
    before = W.partitionBy("at").orderBy("enter", F.col("kid").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    found = ends.unionByName(kids_).select(F.last("kid", ignorenulls=True).over(before).alias("jnid"), "n").groupBy("jnid").agg(F.sum("n").alias("pre_weight"))
    return tree.select("jnid").join(found, "jnid", "left").select("jnid", F.coalesce("pre_weight", F.lit(0)).alias("pre_weight"))


#: Rows of ``filled_pieces``: a vertex and some of its later neighbours, a way that goes on in an earlier block, and the first and last neighbour in a block.
_PIECE, _WAY, _BLOCK = range(3)
_FOUND = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("later", pa.int64()), ("stop", pa.int64()), ("laters", pa.list_(pa.int64()))])
#: Edges of the filled graph that a task holds, as one number each.
_HELD = 1 << 21
#: Bits of a position in such a number; the others are a place in a block.
_LATER_BITS = 44


class _Block:
    """A block of the tour, and the neighbourhoods in it as they come, batch by batch, in the order of later and enter."""

    def __init__(self, size: int) -> None:
        self.size, self.first, self.table = size, 0, None
        self.up, self.names = np.full(size, NONE), np.full(size, NONE)
        self.open, self.last = np.empty((0, 2), np.int64), NONE  # later and first enter of the neighbourhood that isn't finished, and its last enter so far

    def asked(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Takes the lines (cell, null, enter, up, jnid) of a batch; the other rows."""
        is_line = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if not is_line.any():
            return batch
        self.first = int(batch.column(0)[0].as_py()) * self.size
        part = batch.filter(pa.array(is_line))
        at = part.column(2).to_numpy() - self.first
        self.up[at] = part.column(3).fill_null(NONE).to_numpy(zero_copy_only=False)
        self.names[at] = part.column(4).to_numpy()
        return batch.filter(pa.array(~is_line))

    def pairs(self, later: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows are new, which of them have one before; where the ways of the latter meet those of the ones before; and (later, first, last) of neighbourhoods that are finished."""
        if self.table is None:
            self.table = kernels.Least(self.up)
        before_later, before = np.r_[self.open[0, 0] if len(self.open) else NONE, later[:-1]], np.r_[self.last, enter[:-1]]
        begins = later != before_later
        starts = np.flatnonzero(begins)
        told = np.concatenate([self.open, np.stack([later[starts], enter[starts]], axis=1)])
        ends_ = before[starts] if len(self.open) else before[starts[1:]]
        done = np.column_stack([told[:-1], ends_])
        self.open, self.last = told[-1:], enter[-1]
        follows = ~begins & (enter != before)
        stop = self.table.least(before[follows] + 1 - self.first, enter[follows] - self.first)
        return begins | follows, follows, stop, done

    def unfinished(self) -> np.ndarray:
        return np.column_stack([self.open, np.full(len(self.open), self.last)])


def _follow(size: int, paired: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, a, b, c, d): first the lines of one block of the tour (null, enter, up, jnid), then ways (later, enter, stop) -> rows as above. If ``paired``, ways are
    in the order of later and enter and may repeat, and each stops where it meets the one before it; the first of a block is only told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(size)
        held: list[np.ndarray] = []
        count = 0

        def rows(kind: int, at: np.ndarray, later: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(later), pa.array(stop), pa.nulls(len(at), _FOUND.field("laters").type)], schema=_FOUND)

        def pieces() -> pa.RecordBatch:
            nonlocal count
            edges = np.concatenate(held)
            held.clear()
            count = 0
            edges.sort()
            v = edges >> _LATER_BITS
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            edges &= (1 << _LATER_BITS) - 1
            laters = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(edges)].astype(np.int32)), pa.array(edges))
            none = pa.nulls(len(starts), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), _PIECE, np.int32)), pa.array(block.names[v[starts]]), none, none, laters], schema=_FOUND)

        for batch in batches:
            batch = block.asked(batch)
            if not batch.num_rows:
                continue
            later, enter = (batch.column(c).to_numpy() for c in (1, 2))
            if paired:
                _, go, stop, done = block.pairs(later, enter)
                if len(done):
                    yield rows(_BLOCK, done[:, 1], done[:, 0], done[:, 2])
                later, enter = later[go], enter[go]
            else:
                stop = batch.column(3).to_numpy()
            v = enter - block.first
            while len(v):
                held.append(v << _LATER_BITS | later)
                count += len(v)
                if count >= _HELD:
                    yield pieces()
                on = block.up[v]
                goes = on > stop
                beyond = goes & (on < block.first)
                if beyond.any():
                    yield rows(_WAY, on[beyond], later[beyond], stop[beyond])
                goes &= ~beyond
                v, later, stop = on[goes] - block.first, later[goes], stop[goes]
        if len(rest := block.unfinished()):
            yield rows(_BLOCK, rest[:, 1], rest[:, 0], rest[:, 2])
        if held:
            yield pieces()

    return run


def _meet(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as those of ``_follow``, paired -> (enter, n, total, later, last): what is added at ``enter`` to the numbers and the sums of i's, or the first and
    last neighbour of ``later`` in the block. Holds a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(size)
        n, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        names = ["enter", "n", "total", "later", "last"]

        def changes(enter: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(enter), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(enter), pa.array(n), pa.array(total), none, none], names)

        def told(done: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(done), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(done[:, 1]), none, none, pa.array(done[:, 0]), pa.array(done[:, 2])], names)

        for batch in batches:
            batch = block.asked(batch)
            if not batch.num_rows:
                continue
            later, enter = (batch.column(c).to_numpy() for c in (1, 2))
            new, follows, stop, done = block.pairs(later, enter)
            if len(done):
                yield told(done)
            at = enter[new] - block.first
            np.add.at(n, at, 1)
            np.add.at(total, at, later[new])
            later = later[follows]
            near = stop >= block.first
            np.subtract.at(n, stop[near] - block.first, 1)
            np.subtract.at(total, stop[near] - block.first, later[near])
            if not near.all():
                at, inverse = np.unique(stop[~near], return_inverse=True)
                n_, total_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                np.subtract.at(n_, inverse, 1)
                np.subtract.at(total_, inverse, later[~near])
                yield changes(at, n_, total_)
        if len(rest := block.unfinished()):
            yield told(rest)
        at = np.flatnonzero((n != 0) | (total != 0))
        if len(at):
            yield changes(at + block.first, n[at], total[at])

    return run


def _dealt_neighbourhoods(tree: DataFrame, epos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tour; its lines; and each vertex and its earlier neighbours, with the lines of their blocks, dealt by blocks of the tour in the order of vertex and ``enter``."""
    tour = _tour(tree)
    of, none = F.expr(f"enter div {rg.RANGE_ROWS}"), F.lit(None).cast("long")
    place = tour.select(F.col("jnid").alias("lo"), "enter")
    met = epos.where("hi is not null").select("lo", "hi").join(F.broadcast(place) if fits_broadcast(place, 16) else place, "lo").select(F.col("hi").alias("i"), "enter").unionByName(tour.select(F.col("jnid").alias("i"), "enter"))
    met = materialize(met, "met")
    lines = tour.select(of.alias("cell"), none.alias("a"), F.col("enter").alias("b"), F.col("up").alias("c"), F.col("jnid").alias("d"))
    asked = met.select(of.alias("cell"), F.col("i").alias("a"), F.col("enter").alias("b"), none.alias("c"), none.alias("d"))
    return tour, lines, dealt(lines, asked, rg.range_count(tree), ["a"], 4, ("a", "b"))


def _meetings(tour: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks(later, first, last) of each vertex's neighbourhood -> (n, b, least): for the first one of a block, b, of the vertex n, where its way meets that of the last one before."""
    before = F.lag("last").over(W.partitionBy("later").orderBy("first"))
    asked = blocks.select("later", "first", before.alias("before")).where("before is not null")
    return least_of(tour.select(F.col("enter").alias("at"), F.col("up").alias("value")), asked.select((F.col("before") + 1).alias("a"), F.col("first").alias("b"), F.col("later").alias("n")))


def filled_sums(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """jnid, width, total: 1 + the number of later neighbours in the filled graph, and their sum, without making that graph.

    As in ``widths``, each vertex i adds 1, and here i as well, at itself and its earlier neighbours, and takes as much away where their ways meet and at its parent: that adds
    up over subtrees. A task does so for a block of the tour."""
    ranges = rg.range_count(tree)
    tour, _, rows = _dealt_neighbourhoods(tree, epos)
    found = rows.mapInArrow(_meet(rg.RANGE_ROWS), "enter long, n long, total long, later long, last long")
    change = tour.where("up is not null").select(F.col("up").alias("enter"), F.lit(-1).cast("long").alias("n"), (-F.col("jnid")).alias("total"))
    if ranges > 1:
        found = materialize(found, "met_sums")
        meetings = _meetings(tour, found.where("later is not null").select("later", F.col("enter").alias("first"), "last"))
        change = change.unionByName(meetings.select(F.col("least").alias("enter"), F.lit(-1).cast("long").alias("n"), (-F.col("n")).alias("total")))
    change = change.unionByName(found.where("later is null").select("enter", "n", "total")).groupBy("enter").agg(F.sum("n").alias("width"), F.sum("total").alias("total"))
    own = tour.select("jnid", "parent", "enter").join(change, "enter").select("jnid", "parent", "width", "total")
    return rg.subtree_sums(with_last(own, tree), ["width", "total"]).select("jnid", "width", (F.col("total") - F.col("jnid")).alias("total"))


def filled_pieces(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """(jnid, laters): the edges of the filled graph, each once; a vertex's later neighbours come in any number of pieces, ordered within each. There can be
    quadratically many; a task holds _HELD of them.

    i is a later neighbour of the ways from its earlier neighbours up to it. Each way is followed from a neighbour to where it meets that of the one before it (see
    ``widths``), block by block of the tour: a task holds a block, pairs the neighbours of each i that are in it and follows their ways; ways that go on in an earlier block,
    and neighbours whose one before is in an earlier block, are handed on.
    """
    size, ranges = rg.RANGE_ROWS, rg.range_count(tree)
    tour, lines, rows = _dealt_neighbourhoods(tree, epos)
    of, none = F.expr(f"enter div {size}"), F.lit(None).cast("long")
    schema = "kind int, at long, later long, stop long, laters array<long>"
    found = materialize(rows.mapInArrow(_follow(size, True), schema), "followed")
    out = None
    ways = found.where(F.col("kind") == _WAY).select("later", F.col("at").alias("enter"), "stop")
    if ranges > 1:
        meetings = _meetings(tour, found.where(F.col("kind") == _BLOCK).select("later", F.col("at").alias("first"), F.col("stop").alias("last")))
        ways = ways.unionByName(meetings.select(F.col("n").alias("later"), F.col("b").alias("enter"), F.col("least").alias("stop")))
    while True:
        some = found.where(F.col("kind") == _PIECE).select(F.col("at").alias("jnid"), "laters")
        out = some if out is None else out.unionByName(some)
        if ranges <= 1:
            return out
        asked = materialize(ways.select(of.alias("cell"), F.col("later").alias("a"), F.col("enter").alias("b"), F.col("stop").alias("c"), none.alias("d")), "ways")
        if asked.isEmpty():
            return out
        found = materialize(dealt(lines, asked, ranges, ["a", "b"]).mapInArrow(_follow(size, False), schema), "followed")
        ways = found.where(F.col("kind") == _WAY).select("later", F.col("at").alias("enter"), "stop")


def filled(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """jnid, jxn (later neighbours in the filled graph, as positions), width. The result can be quadratic; a row is one vertex's."""
    lists = filled_pieces(tree, epos).groupBy(F.col("jnid").alias("j2")).agg(F.sort_array(F.flatten(F.collect_list("laters"))).alias("jxn"))
    t = tree.select("jnid").join(lists, F.col("jnid") == F.col("j2"), "left").withColumn("jxn", F.coalesce("jxn", F.array().cast("array<long>")))
    return t.select("jnid", "jxn", (1 + F.size("jxn")).cast("long").alias("width"))


def _with_omitted(edges: DataFrame, seq: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """The length of a sequence; the sequence with the vertices of edges that it omits behind it; and the stored positions lo < hi of edges with an end in it."""
    n = last_position(seq) + 1
    e = edges.select("src", "dst").where("src <> dst")
    omitted = e.select(F.explode(F.array("src", "dst")).alias("vid")).distinct().join(seq.select(F.col("vid").alias("v2")), F.col("vid") == F.col("v2"), "left_anti")
    more = ranked(omitted, "vid")
    whole = seq.select("pos", "vid").unionByName(more.select((F.col("pos") + n).alias("pos"), "vid"))
    whole._rows = n + more._rows
    epos = with_ends(e, whole, 16).where(f"least(pos_x, pos_y) < {n}").select(F.least("pos_x", "pos_y").alias("lo"), F.greatest("pos_x", "pos_y").alias("hi"))
    return n, whole, materialize(epos, "epos")


def closed(edges: DataFrame, seq: DataFrame, rooted: bool = False) -> DataFrame:
    """The tree up to the vertex at which it is known how wide it gets: jnid, vid, parent, pst_weight, width.

    That is the first vertex, after which fewer vertices come than the widest one so far has; with ``rooted``, than it has itself, and then all that
    are left form a chain above it, which is what the filled graph has there. Widths are those of ``widths``; vertices that the
    sequence omits count as later ones.
    """
    n, whole, epos = _with_omitted(edges, seq)
    t = materialize(build_tree(epos, whole), "tree")
    t = with_last(materialize(t.join(widths(t, epos), "jnid"), "widths"), t).where(F.col("jnid") < n)
    limit = F.lit(n) - F.col("jnid")
    if rooted:
        end = t.where(F.col("width") >= limit).agg(F.min("jnid")).first()[0]
    else:  # the widest so far: of whole ranges before, and within the range
        blocks = t.groupBy(rg.range_of("jnid").alias("r2")).agg(F.max("width").alias("most"))
        blocks = blocks.withColumn("before", F.max("most").over(W.orderBy("r2").rowsBetween(W.unboundedPreceding, -1))).drop("most")  # a row a range
        near = t.withColumn("range", rg.range_of("jnid")).join(F.broadcast(blocks), F.col("range") == F.col("r2"))
        so_far = F.greatest(F.max("width").over(W.partitionBy("range").orderBy("jnid")), "before")
        end = near.withColumn("most", so_far).where(F.col("most") >= limit).agg(F.min("jnid")).first()[0]
    end = -1 if end is None else end
    named = t.join(seq.select(F.col("pos").alias("p2"), "vid"), F.col("jnid") == F.col("p2"))
    if not rooted:
        return named.where(F.col("jnid") <= end).select("jnid", "vid", F.when(F.col("parent") <= end, F.col("parent")).alias("parent"), "pst_weight", "width")
    after = F.col("jnid") > end
    chain = F.when(F.col("jnid") + 1 < n, F.col("jnid") + 1)
    parent = F.when(after, chain).when(F.col("parent") <= end, F.col("parent")).otherwise(F.lit(end + 1 if end + 1 < n else None).cast("long"))
    return named.select("jnid", "vid", parent.alias("parent"), "pst_weight", F.when(after, limit).otherwise(F.col("width")).cast("long").alias("width"))


def limited(edges: DataFrame, seq: DataFrame, width_limit: int | None = None, find_max_width: bool = False, rooted: bool = False) -> DataFrame:
    """Tree with a limit of width, cut off once its width can't grow, or closed by a chain of all that is left once a vertex is as wide
    as that (``rooted``): jnid, vid, parent, pst_weight, width. A limit or either of these is worked out range by range; several of them at once
    need one task and are for small graphs."""
    if width_limit is None and find_max_width != rooted:
        return closed(edges, seq, rooted)
    if width_limit is not None and not find_max_width and not rooted:
        n, _, epos = _with_omitted(edges, seq)
        return width_limited(epos, seq, n, width_limit)
    both = edges.select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nbrs = seq.join(both.groupBy(F.col("src").alias("vid")).agg(F.collect_list("dst").alias("nbrs")), "vid", "left")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        vids = t["vid"].tolist()
        later = {v: [] if n is None else list(n) for v, n in zip(vids, t["nbrs"], strict=True)}
        out = pd.DataFrame(kernels.limited_tree(later, vids, width_limit, find_max_width, rooted), columns=["jnid", "vid", "parent", "pst_weight", "width"])
        return out.astype({"parent": "Int64"})

    return in_one_task(nbrs.select("pos", "vid", "nbrs"), run, "jnid long, vid long, parent long, pst_weight long, width long")


def validate(tree: DataFrame, epos: DataFrame) -> DataFrame:
    """Counts of broken invariants, all 0 for a sound tree: parents not after their children, weights that don't add up to the edges,
    and edges whose later end isn't above the earlier one. Adding the edges to the tree's own must change nothing."""
    t = tree.select("jnid", "parent", "pst_weight")
    wrong = t.agg(F.count(F.when(F.col("parent") <= F.col("jnid"), 1)).alias("bad_parents"), F.coalesce(F.sum("pst_weight"), F.lit(0)).alias("w"))
    own = t.where("parent is not null").select(F.col("jnid").alias("lo"), F.col("parent").alias("hi"))
    every = own.unionByName(epos.where("hi is not null").select("lo", "hi")).withColumn("w", F.lit(0).cast("long"))
    again = reduce_forests(partial_forests(every), rg.last_id(tree)).select("jnid", F.col("parent").alias("p"))
    moved = t.join(again, "jnid", "left").where(~F.col("parent").eqNullSafe(F.col("p"))).agg(F.count("*").alias("bad_edges"))
    m = epos.agg(F.count("*").alias("m"))
    return wrong.join(m).join(moved).select("bad_parents", "bad_edges", (F.col("w") - F.col("m")).alias("weight_gap"))


#: Children whose neighbours are looked for in their parent's by one task, about.
KIDS = 1 << 14
#: Rows of ``_lacking``: a vertex's later neighbours, those of a child of it, and a vertex whose first one is wrong.
_OWN, _KID, _FIRST = range(3)


def _lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, share, kind, jxn) in this order -> numbers of wrong first neighbours, and of children with a neighbour other than ``at`` that ``at`` lacks. Holds one vertex's
    neighbours and a batch."""
    bad_first = bad_subset = 0
    key, have = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        at, share, kind = (batch.column(c).to_numpy() for c in range(3))
        lists = batch.column(3)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        bad_first += int((kind == _FIRST).sum())
        cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (share[1:] != share[:-1])) + 1, len(at)]
        kids_ = np.add.reduceat(kind == _KID, cuts[:-1], dtype=np.int64)
        for g in np.flatnonzero((kids_ > 0) | (np.arange(len(kids_)) == len(kids_) - 1)).tolist():
            i = int(cuts[g])
            if (at[i], share[i]) != key:
                key, have = (at[i], share[i]), np.empty(0, np.int64)
            if kind[i] == _OWN:
                have = np.unique(values[offsets[i] : offsets[i + 1]])
                i += 1
            j = i + int(kids_[g])
            if i == j:
                continue
            x = values[offsets[i] : offsets[j]]
            lack = x != key[0]
            if len(have):
                row = np.minimum(np.searchsorted(have, x), len(have) - 1)
                lack &= have[row] != x
            bad_subset += int(np.logical_or.reduceat(lack, offsets[i:j] - offsets[i]).sum())
    yield pa.RecordBatch.from_arrays([pa.array([bad_first], pa.int64()), pa.array([bad_subset], pa.int64())], ["bad_first", "bad_subset"])


def validate_filled(tree: DataFrame, filled: DataFrame) -> DataFrame:
    """Counts of broken invariants of the filled graph, all 0 for a sound one: bad_first, vertices whose parent isn't their first later
    neighbour, and bad_subset, those with a further later neighbour that their parent lacks.

    Each list is sent twice, as a vertex's own and to its parent, where it streams past the parent's; a parent with over KIDS children goes to several tasks."""
    kids_ = tree.where("parent is not null").groupBy(F.col("parent").alias("p2")).agg(F.ceil(F.count("*") / KIDS).cast("long").alias("shares"))
    many = kids_.where("shares > 1").select(F.col("p2").alias("p3"), F.col("shares").alias("of"))  # at most one in KIDS vertices
    t = tree.select("jnid", "parent").join(kids_, F.col("jnid") == F.col("p2"), "left").join(F.broadcast(many), F.col("parent") == F.col("p3"), "left")
    own = t.join(filled.select(F.col("jnid").alias("j2"), "jxn"), F.col("jnid") == F.col("j2"))
    zero = F.lit(0).cast("long")
    first = F.get("jxn", F.lit(0))
    row = lambda at, kind, share, jxn: F.struct(at.alias("at"), share.alias("share"), F.lit(kind).alias("kind"), jxn.alias("jxn"))
    empty = F.array().cast("array<long>")
    asks = F.col("parent").isNotNull() & (F.size("jxn") > 0) & ~((F.size("jxn") == 1) & first.eqNullSafe(F.col("parent")))
    mine = F.when(F.col("shares").isNotNull(), F.transform(F.sequence(zero, F.col("shares") - 1), lambda k: row(F.col("jnid"), _OWN, k, F.col("jxn")))).otherwise(F.array())
    theirs = F.when(asks, F.array(row(F.col("parent"), _KID, F.pmod(F.xxhash64("jnid"), F.coalesce("of", F.lit(1).cast("long"))), F.col("jxn")))).otherwise(F.array())
    wrong = F.when(~first.eqNullSafe(F.col("parent")), F.array(row(F.col("jnid"), _FIRST, zero, empty))).otherwise(F.array())
    rows = own.select(F.inline(F.concat(mine, theirs, wrong))).repartition("at", "share").sortWithinPartitions("at", "share", "kind")
    counts = rows.mapInArrow(_lacking, "bad_first long, bad_subset long")
    return counts.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("bad_first", "bad_subset")))
