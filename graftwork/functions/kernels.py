"""Sequential kernels on plain arrays: what no relational operator expresses. No Spark in here."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

NONE = -1


class Forest:
    """An elimination forest under construction. Edges (lo, hi) must come in the order of hi.

    ``top`` of a set is its highest vertex so far. Memory is proportional to the vertices met.
    """

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def top(self, v: int) -> int:
        up = self.up
        root = v
        while (n := up.get(root, root)) != root:
            root = n
        while v != root:
            up[v], v = root, up.get(v, v)
        return root

    def edge(self, lo: int, hi: int) -> int:
        """Returns the vertex below ``hi`` on lo's way up (hi itself if it is there already)."""
        k = self.top(lo)
        if k != hi:
            self.parent[k] = self.up[k] = hi
        return k

    def edges(self, los: list[int], his: list[int]) -> None:
        """Many edges at once; ways to the top are halved as they are walked."""
        up, parent = self.up, self.parent
        for lo, hi in zip(los, his, strict=True):
            v = lo
            while (n := up.get(v, v)) != v:
                up[v] = v = up.get(n, n)
            if v != hi:
                parent[v] = up[v] = hi


def _ints(x: np.ndarray, at_once: int = 1 << 14) -> Iterator[int]:
    """The numbers of an array, which aren't all made at once."""
    return chain.from_iterable(x[k : k + at_once].tolist() for k in range(0, len(x), at_once))


def forest(los: np.ndarray, his: np.ndarray, vertices: int) -> array:
    """Parents in the elimination forest of edges (lo, hi) between vertices 0, 1, ..., in the order of hi; NONE for a root. Ways to
    the top are halved as they are walked."""
    up, parent = array("i", range(vertices)), array("i", [NONE]) * vertices
    for v, hi in zip(_ints(los), _ints(his), strict=True):
        while (n := up[v]) != v:
            up[v] = v = up[n]
        if v != hi:
            parent[v] = up[v] = hi
    return parent


#: Ends of edges that are held as one number must be less.
FAR = 1 << 31


def pairs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Edges as one number each, in whose order they are in the order of hi."""
    return (hi << 32) | lo


def ends(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return edges & (1 << 32) - 1, edges >> 32


def shrink(edges: np.ndarray, at_once: int = 1 << 14) -> int:
    """Puts the elimination forest of edges, one number each, in their place, in the order of hi; returns its number of edges. Beside the edges it
    takes as many bytes at most to find their vertices, and then 8 a vertex."""
    edges.sort()
    v = edges.view(np.uint32).copy()  # both ends of all edges
    v.sort()
    v = v[np.r_[True, v[1:] != v[:-1]]]
    up, n = array("i", range(len(v))), 0
    for k in range(0, len(edges), at_once):
        xs, ys = (np.searchsorted(v, e.astype(np.uint32)).tolist() for e in ends(edges[k : k + at_once]))
        lo, hi = [], []
        for x, y in zip(xs, ys, strict=True):
            while (m := up[x]) != x:
                up[x] = x = up[m]
            if x != y:
                up[x] = y
                lo.append(x)
                hi.append(y)
        edges[n : n + len(lo)] = pairs(v[lo].astype(np.int64), v[hi].astype(np.int64))  # never beyond those that were read
        n += len(lo)
    return n


class Least:
    """The least of any run of values, from the least of all runs whose lengths are powers of 2."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            v, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each run, both ends included; the largest number for an empty one."""
        out = np.full(len(first), np.iinfo(np.int64).max)
        length = last - first + 1
        level = np.frexp(np.maximum(length, 1))[1] - 1
        for k in np.unique(level[length > 0]).tolist():
            rows = np.flatnonzero((level == k) & (length > 0))
            out[rows] = np.minimum(self.levels[k][first[rows]], self.levels[k][last[rows] - (1 << k) + 1])
        return out


def path_figures(parent: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """depth, vertices and weight on the way to the root, height above the leaves, size and weight of subtrees, and enter: a number
    such that a subtree's vertices have those from its root's on."""
    n = len(parent)
    depth, above = np.zeros(n, np.int64), np.array(weight, np.int64)
    height, size, below = np.zeros(n, np.int64), np.ones(n, np.int64), np.array(weight, np.int64)
    p = parent.tolist()
    for v in range(n):
        if p[v] != NONE:
            height[p[v]] = max(height[p[v]], height[v] + 1)
            size[p[v]] += size[v]
            below[p[v]] += below[v]
    enter, free, roots = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for v in range(n - 1, -1, -1):
        if p[v] != NONE:
            depth[v] = depth[p[v]] + 1
            above[v] += above[p[v]]
            enter[v] = free[p[v]]
            free[p[v]] += size[v]
        else:
            enter[v], roots = roots, roots + size[v]
        free[v] = enter[v] + 1
    return {"depth": depth, "path_weight": above, "height": height, "subtree_size": size, "subtree_weight": below, "enter": enter}


def filled_neighbours(parent: np.ndarray, later: list[set[int]]) -> list[list[int]]:
    """Higher neighbours of each vertex in the filled graph: its own later ones and those of its children, but for itself."""
    sets = [set(x) for x in later]
    for v, p in enumerate(parent.tolist()):
        if p != NONE:
            sets[p] |= sets[v] - {p}
    return [sorted(s - {v}) for v, s in enumerate(sets)]


def limited_tree(later: dict[int, list[int]], order: list[int], width_limit: int | None, find_max_width: bool, rooted: bool = False) -> list[dict]:
    """Tree of vertices inserted in ``order``; ones wider than the limit wait until the end, where they form a chain.

    ``later``: all neighbours of each vertex, with multiplicity. Returns rows jnid, vid, parent, pst_weight, width. With
    ``find_max_width`` it stops as soon as the vertices that are left can't widen the tree. With ``rooted``, once a vertex is as
    wide as all that are left with it, those form a chain above it.
    """
    at: dict[int, int] = {}
    rows: list[dict] = []
    top: list[int] = []
    filled: list[set[int]] = []

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    def add(v: int, kids: Iterable[int], pst: int, jxn: set[int], width: int) -> None:
        j = len(rows)
        for k in kids:
            rows[k]["parent"] = top[k] = j
            filled[k] = set()  # only roots are asked again
        top.append(j)
        filled.append(jxn)
        at[v] = j
        rows.append({"jnid": j, "vid": v, "parent": None, "pst_weight": pst, "width": width})

    wide: list[int] = []
    most = 0
    for i, v in enumerate(order):
        kids = {find(at[u]) for u in later.get(v, ()) if u in at}
        ahead = [u for u in later.get(v, ()) if u not in at and u != v]
        jxn = set(ahead).union(*(filled[k] for k in kids)) - {v}
        if width_limit is not None and (len(ahead) > width_limit or len(jxn) > width_limit):
            wide.append(v)
        else:
            add(v, kids, len(ahead), jxn, 1 + len(jxn))
            most = max(most, 1 + len(jxn))
        if find_max_width and most >= len(wide) + len(order) - i:
            return rows
        if rooted and rows and rows[-1]["vid"] == v and rows[-1]["width"] >= len(wide) + len(order) - i:
            wide += order[i + 1 :]
            break
    for i, v in enumerate(wide):
        kids = [j for j, r in enumerate(rows) if r["parent"] is None] if i == 0 else [len(rows) - 1]
        add(v, kids, sum(u not in at and u != v for u in later.get(v, ())), set(), len(wide) - i)
        if find_max_width:
            break
    return rows


def capacity(total: int, parts: int, balance: float) -> int:
    """Whole division first, then the factor, then cut to a whole number."""
    return int((total // parts) * balance)


def pack_forward(parent: np.ndarray, weight: np.ndarray, cap: int) -> np.ndarray:
    """Bottom up, a subtree over the cap gives its largest child subtrees to the first parts with room; top down, the rest
    inherits its parent's part, and what is left of a root goes to the last part with room. Ties: smaller child first. A vertex takes
    some 50 bytes, in arrays."""
    n = len(parent)
    if n and weight.max() > cap:
        raise ValueError(f"a vertex weighs {int(weight.max())}, over the capacity {cap} of a part")
    part, rest, size = np.full(n, NONE, np.int64), weight.astype(np.int64), []
    by = np.argsort(parent, kind="stable")  # roots, then children, those of a vertex together and in order
    ends = np.searchsorted(parent[by], np.arange(n + 1))
    for v in _ints(np.flatnonzero(ends[1:] > ends[:-1])):
        kids = by[ends[v] : ends[v + 1]]
        total = int(rest[v] + rest[kids].sum())
        if total > cap:
            waiting = kids[np.argsort(-rest[kids], kind="stable")]
            while total > cap:
                left = array("q")
                for k, w in zip(_ints(waiting), _ints(rest[waiting]), strict=True):
                    if total <= cap:  # all others stay
                        break
                    p = next((p for p, s in enumerate(size) if s + w <= cap), None)
                    if p is None:
                        left.append(k)
                        continue
                    part[k] = p
                    size[p] += w
                    total -= w
                waiting = np.array(left, np.int64)
                if total > cap:
                    size.append(0)
        rest[v] = total
    for v in range(n - 1, -1, -1):
        if part[v] == NONE:
            if parent[v] != NONE:
                part[v] = part[parent[v]]
                continue
            w = int(rest[v])
            p = next((p for p in range(len(size) - 1, -1, -1) if size[p] + w <= cap), None)
            if p is None:
                p = len(size)
                size.append(0)
            part[v], size[p] = p, size[p] + w
    return part


def pack_critical(parent: np.ndarray, weight: np.ndarray, cap: int) -> np.ndarray:
    """Cuts the heaviest root-to-leaf way into parts; all other vertices take the part of the nearest one above on it."""
    n = len(parent)
    if not n:
        return np.full(n, NONE, np.int64)
    below = path_figures(parent, weight)["subtree_weight"]
    heaviest = np.full(n + 1, NONE, np.int64)  # child of each vertex; those without a parent go to the last place
    by = np.lexsort((-np.arange(n), below))  # lightest first, so that the heaviest, smallest one is written last
    heaviest[np.where(parent[by] == NONE, n, parent[by])] = by
    way = [int(below.argmax())]
    while (v := int(heaviest[way[-1]])) != NONE:
        way.append(v)
    own = below[way] - np.append(below[way[1:]], 0)
    part = np.full(n, NONE, np.int64)
    ends = np.cumsum(own[::-1])
    at = now = 0
    while at < len(way):  # a part takes what stays below the cap, and its first vertex whatever it weighs
        base = ends[at - 1] if at else 0
        stop = max(at + (now > 0), int(np.searchsorted(ends, base + cap)))
        part[way[::-1][at:stop]] = now
        at, now = stop, now + 1
    last = part[way[0]]
    for v in np.flatnonzero(part == NONE)[::-1].tolist():
        part[v] = part[parent[v]] if parent[v] != NONE else last
    return part


def fill(order: np.ndarray, weight: np.ndarray, cap: int) -> np.ndarray:
    """Vertices in ``order`` fill part after part; the one that reaches the cap still belongs to its part."""
    part, now, size = np.full(len(weight), NONE, np.int64), 0, 0
    for v in order.tolist():
        part[v] = now
        size += int(weight[v])
        if size >= cap:
            now, size = now + 1, 0
    return part


class VertexStream:
    """One pass over vertices 0, 1, ...; each joins the part with most of its neighbours, less a growing cost of size.

    All parts up to the first empty one are weighed up at once; if none has room, it is the first part. Held: a part for each vertex.
    """

    def __init__(self, vertices: int, edges: int, k: int, balance: float, by_edges: bool, power: float = 1.5) -> None:
        n, m = vertices, 2 * edges
        self.k, self.by_edges, self.power = k, by_edges, power
        self.cap = capacity(m if by_edges else n, k, balance)
        self.a = (n * (k / m) ** power if by_edges else m * k ** (power - 1) / n**power) if n and m else 0.0
        self.vertices, self.where = n, np.empty(0, np.int32)  # made by the task that begins
        self.size, self.cost, self.filled = np.zeros(k), np.zeros(k), 0  # a part's cost so far; parts fill up one after the other
        self.now, self.weight, self.near = NONE, 0, np.zeros(k, np.int64)

    def _place(self) -> None:
        """The vertex that all rows have come of."""
        w, size, open_ = self.weight if self.by_edges else 1, self.size, min(self.k, self.filled + 1)
        grown = self.a * (size[:open_] + w) ** self.power
        gain = np.where(size[:open_] + w <= self.cap, self.near[:open_] - (grown - self.cost[:open_]), -np.inf)
        best = int(gain.argmax())
        if gain[best] == -np.inf:
            best = 0
        self.where[self.now] = best
        size[best] += w
        self.cost[best] = self.a * size[best] ** self.power
        self.filled = max(self.filled, best + (size[best] > 0))

    def take(self, vertex: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of both columns: for each vertex one with its degree, negative, and one for each earlier neighbour. Returns the
        vertices that are placed by now, and their parts; one stays until a later one comes, or ``finish``."""
        begun = self.now
        if not len(self.where):
            self.where = np.full(self.vertices, NONE, np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(vertex)) + 1).tolist(), len(vertex)] if len(vertex) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if near[i] < 0:
                if self.now != NONE:
                    self._place()
                self.now, self.weight = int(vertex[i]), -int(near[i])
                self.near[:] = 0
                i += 1
            if i < j:
                self.near += np.bincount(self.where[near[i:j]], minlength=self.k)
        return self._since(begun, self.now)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        begun = self.now
        if begun != NONE:
            self._place()
        return self._since(begun, len(self.where))

    def _since(self, begun: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        done = np.arange(max(begun, 0), max(end, 0))
        return done, self.where[done]


class EdgeStream:
    """One pass over edges; each joins the part that knows most of its ends, less a growing cost of size; both ends are marked. Held: a bit for each vertex and part."""

    def __init__(self, vertices: int, edges: int, k: int, balance: float, power: float = 1.5) -> None:
        self.k, self.power = k, power
        self.cap, self.a = max(1, capacity(edges, k, balance)), vertices * (k / edges) ** power if edges else 0.0
        self.size = [0] * k
        self.cost = [self._next(0)] * k
        self.bytes, self.knows = vertices // 8 + 1, []  # of the parts up to the first empty one

    def _next(self, size: int) -> float:
        return self.a * ((size + 1) ** self.power - size**self.power)

    def take(self, x: np.ndarray, y: np.ndarray, *carried: np.ndarray) -> tuple[np.ndarray, ...]:
        """The columns that are carried along, and the parts of edges between vertices x and y."""
        size, cost, knows, cap, out = self.size, self.cost, self.knows, self.cap, np.empty(len(x), np.int64)
        for i, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            best, top = NONE, 0.0
            uq, ur, vq, vr = u >> 3, u & 7, v >> 3, v & 7
            for p in range(self.k):
                if p == len(knows):
                    knows.append(bytearray(self.bytes))
                if size[p] < cap:
                    known = knows[p]
                    value = (known[uq] >> ur & 1) + (known[vq] >> vr & 1) - cost[p]
                    if best == NONE or value > top:
                        best, top = p, value
                if not size[p]:
                    break
            if best == NONE:
                best = min(range(self.k), key=size.__getitem__)
            out[i] = best
            size[best] += 1
            cost[best] = self._next(size[best])
            knows[best][uq] |= 1 << ur
            knows[best][vq] |= 1 << vr
        return (*carried, out)

    def finish(self) -> tuple[np.ndarray, ...]:
        return ()
