"""Trees under a limit of width, range by range.

A vertex that is wider than the limit waits until the end. Which ones do depends on all before, but only by what they touch: of the vertices below, a
component is known by its root and its members, the vertices that aren't in the tree and have a neighbour in it. A root has no
more members than the limit, so a component is one short row. It goes from range to range, to the next of its members each time.

Most vertices that wait do so whatever comes before: those with more later neighbours than the limit, then those with too many of these and of such earlier
ones. They are found first, by counting, and known by a bit each. Only the *open* others are settled, and what touches none of them goes nowhere.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import ranges as rg

#: Rows of a settled range: for a later range (v meets a waiting vertex ``other``, or a component with ``root`` and ``members``), v in the tree, v waiting,
#: and the parent of v.
MEETS, PLACED, WAITS, LINK = range(4)
_SCHEMA = pa.schema([("kind", pa.int64()), ("v", pa.int64()), ("other", pa.int64()), ("root", pa.int64()), ("members", pa.list_(pa.int64())), ("weight", pa.int64()), ("width", pa.int64())])
_ROWS = "kind long, v long, other long, root long, members array<long>, weight long, width long"
#: In the place of a neighbour: the vertex has an open one before it.
_TOUCHED = -2
#: Rows that are kept before they are handed on.
_AT_ONCE = 1 << 15
#: How often vertices that wait for sure are looked for; it doesn't change what comes out.
SURE_ROUNDS = 4


class Marks:
    """A bit for each of the positions 0 .. n - 1; those from n on are unmarked."""

    def __init__(self, n: int) -> None:
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.n = n

    def put(self, positions: DataFrame) -> int:
        """Marks positions(v), each of them given once and unmarked; their number. The bits of each range are put together by a task."""
        size = -(-rg.RANGE_ROWS // 64) * 64

        def run(key: tuple, table: pa.Table) -> pa.Table:
            bits = np.zeros(size, np.uint8)
            bits[table["v"].to_numpy() - key[0].as_py() * size] = 1
            return pa.table({"cell": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, pa.schema([("cell", pa.int64()), ("bits", pa.binary())]))

        before = int(np.bitwise_count(self.words).sum())
        for cell, bits in positions.groupBy(F.expr(f"v div {size}").alias("cell")).applyInArrow(run, "cell long, bits binary").collect():  # a row a range
            at, more = cell * (size // 64), np.frombuffer(bytes(bits), np.uint64)
            self.words[at : at + len(more)] |= more[: len(self.words) - at]
        return int(np.bitwise_count(self.words).sum()) - before

    def has(self, v: np.ndarray) -> np.ndarray:
        at = np.where((v >= 0) & (v < self.n), v, 0)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (at == v)

    def before(self, v: np.ndarray) -> np.ndarray:
        """The number of marked positions before each."""
        sums = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        return sums[v >> 6] + np.bitwise_count(self.words[v >> 6] & ((np.uint64(1) << (v & 63).astype(np.uint64)) - np.uint64(1)))


def _mapped(df: DataFrame, run: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """``run`` on the columns of each batch, longs in which rg.NONE stands for null."""
    names = [c.split()[0] for c in schema.split(", ")]

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = run(*(c.fill_null(rg.NONE).to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=c == rg.NONE) for c in columns], names)

    return df.mapInArrow(every, schema)


def surely_waiting(epos: DataFrame, n: int, limit: int) -> Marks:
    """Vertices that wait whatever happens to those that aren't among them."""
    sure = Marks(n)
    edges = epos.select("lo", "hi")
    later = materialize(edges.groupBy(F.col("lo").alias("v")).agg(F.count("*").alias("later")), "later")
    more = sure.put(later.where(F.col("later") > limit).select("v"))
    for _ in range(SURE_ROUNDS):
        if not more:
            break

        def met(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
            return [hi[sure.has(lo) & (hi < n) & ~sure.has(hi)]]

        counts = _mapped(edges, met, "v2 long").groupBy("v2").agg(F.count("*").alias("earlier")).join(later, F.col("v2") == F.col("v"), "left")
        found = counts.where(F.col("earlier") + F.coalesce("later", F.lit(0)) > limit).select(F.col("v2").alias("v"))
        more = sure.put(found)
    return sure


def _settled(limit: int, n: int, size: int, sure: Marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (range, v, other, root, members) of open vertices v in the order of range and v -> rows as above. Those without open neighbours are settled at once, the others
    one by one.

    Memory: components with an open member in the range, and the edges between its open waiting vertices; a bit for each vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = array("Q", sure.words.tobytes())
        out: list[list] = [[] for _ in _SCHEMA]
        here: dict[int, list] = {}  # components by the next of their members
        held: dict[int, list[int]] = {}  # waiting vertices of this range by their later neighbours
        many: list[tuple[int, np.ndarray, int]] = []  # kind, vs, other: rows that differ by v alone
        end = rows = 0

        def put_all(kind: int, vs: np.ndarray, other: int) -> None:
            nonlocal rows
            if len(vs):
                many.append((kind, vs, other))
                rows += len(vs)

        def put(kind: int, v: int, other: int | None = None, root: int | None = None, members: array | None = None, weight: int = 0, width: int = 0) -> None:
            for column, x in zip(out, (kind, v, other, root, members, weight, width), strict=True):
                column.append(x)

        def send(v: int, component: tuple[int, array]) -> None:
            members = component[1]
            at = bisect_right(members, v)
            while at < len(members) and members[at] < n and words[members[at] >> 6] >> (members[at] & 63) & 1:
                at += 1
            if at == len(members) or members[at] >= n:
                return
            if members[at] < end:
                here.setdefault(members[at], []).append(component)
            else:
                put(MEETS, members[at], root=component[0], members=members)

        def vertex(v: int, near: np.ndarray, met: list) -> None:
            waiting, components = held.pop(v, []), met + here.pop(v, [])
            weight = len(near) + len(waiting)
            jxn = None
            if weight <= limit:
                jxn = {*near.tolist(), *waiting}
                for _, members in components:
                    jxn.update(members)
                    if len(jxn) > limit + 1:
                        break
                jxn.discard(v)
            if jxn is not None and len(jxn) <= limit:
                put(PLACED, v, weight=weight, width=1 + len(jxn))
                for root, _ in components:
                    put(LINK, root, other=v)
                send(v, (v, array("q", sorted(jxn))))
                return
            put(WAITS, v)
            near = near[~sure.has(near)]
            for u in near[(near > v) & (near < end)].tolist():
                held.setdefault(u, []).append(v)
            put_all(MEETS, near[(near >= end) & (near < n)], v)
            for c in components:
                send(v, c)

        def taken() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
            if many:
                kinds, vs, others = zip(*many, strict=True)
                lengths = [len(x) for x in vs]
                known = {"kind": np.repeat(kinds, lengths), "v": np.concatenate(vs), "other": np.repeat(others, lengths)}
                yield pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)
            for column in (*out, many):
                column.clear()
            rows = 0

        at, near, met = None, [], []

        def finish() -> None:
            vertex(at, np.concatenate(near), met)

        def alone(v: np.ndarray, other: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            """Of whole vertices whose neighbours all wait, or come later and will."""
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(v)]))
            real = other != rg.NONE
            group, other = group[real], other[real]
            by = np.lexsort((other, group))
            group, other = group[by], other[by]
            new = np.ones(len(group), bool)
            new[1:] = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
            weight, width = np.bincount(group, minlength=len(starts)), 1 + np.bincount(group[new], minlength=len(starts))
            known = {"kind": np.where(weight <= limit, PLACED, WAITS), "v": v[starts], "weight": weight, "width": width}
            return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(starts), f.type) for f in _SCHEMA], schema=_SCHEMA)

        for batch in batches:
            v, other = batch.column(1).to_numpy(), batch.column(2).fill_null(rg.NONE).to_numpy(zero_copy_only=False)
            has_root = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            if not len(v):
                continue
            cuts = np.r_[0, np.flatnonzero(np.diff(v)) + 1, len(v)]
            touched = has_root | (other == _TOUCHED) | ((other >= 0) & (other < n) & ~sure.has(other))
            single = ~np.logical_or.reduceat(touched, cuts[:-1])
            single[[0, -1]] = False  # these may go on in another batch
            if single.any():
                lengths = np.diff(cuts)
                rows_ = np.repeat(single, lengths)
                yield alone(v[rows_], other[rows_], np.r_[0, np.cumsum(lengths[single])[:-1]])
            for i, j in zip(cuts[:-1][~single].tolist(), cuts[1:][~single].tolist(), strict=True):
                if v[i] != at:
                    if at is not None:
                        finish()
                    at, near, met = int(v[i]), [], []
                    if at >= end:
                        end, here, held = min(n, (at // size + 1) * size), {}, {}
                    if len(out[0]) >= _AT_ONCE or rows >= 16 * _AT_ONCE:
                        yield from taken()
                near.append(other[i:j][other[i:j] >= 0])
                met += [(batch.column(3)[k].as_py(), array("q", batch.column(4)[k].values.to_numpy().tobytes())) for k in (np.flatnonzero(has_root[i:j]) + i).tolist()]
        if at is not None:
            finish()
            yield from taken()

    return run


def levels(pairs: list[tuple[int, int]], ranges: int) -> list[list[int]]:
    """Ranges that can be settled at once, step by step, given which ones have edges to which later ones.

    A component of one range can join two later ones, so what follows a range is joined as well: these are the steps of the elimination of a
    graph of ranges."""
    later: list[set[int]] = [set() for _ in range(ranges)]
    for a, b in pairs:
        later[a].add(b)
    level = [0] * ranges
    for r, after in enumerate(later):
        for x in after:
            level[x] = max(level[x], level[r] + 1)
        if after:
            later[min(after)] |= after - {min(after)}
    return [[r for r in range(ranges) if level[r] == k] for k in range(max(level, default=-1) + 1)]


def width_limited(epos: DataFrame, seq: DataFrame, n: int, limit: int) -> DataFrame:
    """jnid, vid, parent, pst_weight, width of the tree over seq(pos, vid), whose positions are 0 .. n - 1, in which vertices wider than ``limit``, by edges
    or in the filled graph, come last as a chain. epos(lo, hi): lo < hi, lo < n; vertices from n on are none of the tree."""
    size = rg.RANGE_ROWS
    ranges = max(1, -(-n // size))
    none = F.lit(None)
    edges = epos.select("lo", "hi")
    sure = surely_waiting(edges, n, limit)

    def between(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        a, b = lo // size, hi // size
        both = np.unique(np.stack([a, b])[:, ~sure.has(lo) & ~sure.has(hi) & (hi < n) & (a != b)], axis=1)
        return [both[0], both[1]]

    def open_rows(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:  # those of an open vertex: its later neighbours, earlier ones that wait, and whether there are open ones
        waits = sure.has(lo)
        back = (hi != rg.NONE) & (hi < n) & ~sure.has(hi)
        return [np.r_[lo[~waits], hi[back]], np.r_[hi[~waits], np.where(waits, lo, _TOUCHED)[back]]]

    pairs = _mapped(edges, between, "a long, b long").distinct().collect()  # of ranges, not of vertices
    steps = levels([(r["a"], r["b"]) for r in pairs], ranges)
    given = _mapped(edges.unionByName(seq.select(F.col("pos").alias("lo"), none.cast("long").alias("hi"))), open_rows, "v long, other long")
    given = given if len(steps) == 1 else materialize(given, "open")
    given = given.select("v", "other", none.cast("long").alias("root"), F.array().cast("array<long>").alias("members"))  # null lists are slow to hand to Python
    tables: list[DataFrame] = []
    for some in steps:
        rows = given
        for t in tables:
            rows = rows.unionByName(t.where(F.col("kind") == MEETS).select("v", "other", "root", F.coalesce("members", F.array().cast("array<long>")).alias("members")))
        rows = rows.select(rg.range_of("v").alias("range"), "*").where(F.col("range").isin(some))
        slot = F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(some) for x in (r, i))), F.col("range").cast("int"))
        rows = rows.repartitionById(len(some), slot).sortWithinPartitions("v")  # so by range as well, but that tells rows of a task apart at once
        tables.append(materialize(rows.mapInArrow(_settled(limit, n, size, sure), _ROWS), "limited"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    waiting = Marks(n)
    waiting.words = sure.words.copy()
    waiting.put(every.where(F.col("kind") == WAITS).select("v"))
    chain = n - int(np.bitwise_count(waiting.words).sum())

    def ahead(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:  # of the chain: its vertices' neighbours that come later in it, or aren't in the tree
        return [lo[waiting.has(lo) & ((hi >= n) | waiting.has(hi))]]

    nodes = seq.select(F.col("pos").alias("v"), F.col("vid"), *(none.cast("long").alias(c) for c in ("weight", "width", "up")))
    for some in (
        every.where(F.col("kind") == PLACED).select("v", none.cast("long").alias("vid"), "weight", "width", none.cast("long").alias("up")),
        every.where(F.col("kind") == LINK).select("v", *(none.cast("long").alias(c) for c in ("vid", "weight", "width")), F.col("other").alias("up")),
        _mapped(edges, ahead, "v long").groupBy("v").agg(F.count("*").alias("weight")).select("v", none.cast("long").alias("vid"), "weight", *(none.cast("long").alias(c) for c in ("width", "up"))),
    ):
        nodes = nodes.unionByName(some)
    nodes = nodes.groupBy("v").agg(*(F.max(c).alias(c) for c in ("vid", "weight", "width", "up")))  # there is one of each at most

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, weight, width, up = (batch.column(c).fill_null(rg.NONE).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
            waits, skipped = waiting.has(v), waiting.before(v)
            jnid = np.where(waits, chain + skipped, v - skipped)
            above = np.maximum(up, 0)
            parent = np.where(up == rg.NONE, chain if chain < n else rg.NONE, above - waiting.before(above))
            parent = np.where(waits, np.where(jnid + 1 < n, jnid + 1, rg.NONE), parent)
            weight, width = np.where(waits & (weight == rg.NONE), 0, weight), np.where(waits, n - jnid, width)
            yield pa.RecordBatch.from_arrays([pa.array(jnid), batch.column(1), pa.array(parent, mask=parent == rg.NONE), pa.array(weight), pa.array(width)], ["jnid", "vid", "parent", "pst_weight", "width"])

    return nodes.mapInArrow(numbered, "jnid long, vid long, parent long, pst_weight long, width long")
