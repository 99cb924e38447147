"""What ranges send to later ones, and what packing holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from graftwork.functions import kernels
from graftwork.operators import tree

from .test_graphs import parents_by_definition


def batches(edges, size, at_once=7):
    rows = sorted(((a // size, a, b, 1, size) for a, b in edges), key=lambda r: (r[0], r[2], r[1]))
    for k in range(0, len(rows), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + at_once], strict=True)], ["range", "lo", "hi", "w", "size"])


@pytest.mark.parametrize("later", [12, 200])
def test_ranges_send_forests(later):
    """Sets of later vertices that many components meet come as their forest, not component by component."""
    size, rng = 64, random.Random(later)
    edges = sorted({(a, size + rng.randrange(later)) for a in range(size) for _ in range(20)})
    sent, done = [], []
    for b in tree._in_its_range(batches(edges, size)):
        for lo, hi, _, is_done in zip(*(c.to_pylist() for c in b.columns), strict=True):
            (done if is_done else sent).append((lo, hi))
    assert len(sent) < later or later > 4 * size
    own = [e for e in done if e[1] is not None]
    n = size + later
    assert parents_by_definition(n, own + sent) == parents_by_definition(n, edges)


def test_sent_edges_are_bounded():
    """Far more later vertices than a task may hold edges: forests go out on the way, and nothing is lost."""
    rng, held, sent = random.Random(3), tree._Sent(40), []
    edges = [tuple(sorted(rng.sample(range(90), 2))) for _ in range(700)]
    for k in range(0, 700, 9):
        for b in held.add(*map(list, zip(*edges[k : k + 9], strict=True))):
            sent += zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)
        assert held.rows < 40
    for b in held.rest():
        sent += zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)
    assert len(sent) < 700
    assert parents_by_definition(90, sent) == parents_by_definition(90, edges)


def test_sent_edges_are_held_once():
    """A forest is made in little more than the arrays that hold its edges."""
    most, rng = 200_000, np.random.default_rng(5)
    held = tree._Sent(most)
    a, b = rng.integers(0, 60_000, (2, 2 * most))
    lo, hi = np.minimum(a, b), np.maximum(a, b) + 1
    tracemalloc.start()
    sent = [r for k in range(0, 2 * most, 5000) for r in held.add(lo[k : k + 5000], hi[k : k + 5000])]
    most_held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not sent and most_held < 60 * most  # 153 * most when edges were gathered, sorted and numbered in arrays of their own
    sent = [e for r in held.rest() for e in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
    want = kernels.Forest()
    by = np.argsort(hi, kind="stable")
    want.edges(lo[by].tolist(), hi[by].tolist())
    got = kernels.Forest()
    got.edges(*map(list, zip(*sorted(sent, key=lambda e: e[1]), strict=True)))
    assert got.parent == want.parent


def test_sent_edges_become_their_forest_in_place():
    """However many vertices they have, and also where some are too far away to be held."""
    most, base, rng = 100_000, 1 << 40, np.random.default_rng(6)
    held = tree._Sent(most, base)
    a, b = rng.integers(0, 1_000_000, (2, most))
    lo, hi = np.minimum(a, b) + base, np.maximum(a, b) + 1 + base
    hi[::1000] += 1 << 31
    tracemalloc.start()
    sent = [r for k in range(0, most, 5000) for r in held.add(lo[k : k + 5000], hi[k : k + 5000])]
    most_held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most_held < 60 * most  # 77 * most when they were sorted into arrays of their own
    sent += list(held.rest())
    got, want = kernels.Forest(), kernels.Forest()
    got.edges(*map(list, zip(*sorted((e for r in sent for e in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)), key=lambda e: e[1]), strict=True)))
    by = np.argsort(hi, kind="stable")
    want.edges(lo[by].tolist(), hi[by].tolist())
    assert got.parent == want.parent


def test_a_piece_of_a_partition_is_held_once():
    """Its rows, its vertices and their parents, and rows that go out a few at a time."""
    rows, rng = 100_000, np.random.default_rng(7)
    a, b = rng.integers(0, 10**9, (2, 2 * rows))
    hi = np.sort(np.maximum(a, b) + 1)
    lo = np.minimum(a, hi - 1)
    batches = [pa.record_batch([pa.array(x[k : k + 5000]) for x in (lo, hi, np.ones(2 * rows, np.int64))], ["lo", "hi", "w"]) for k in range(0, 2 * rows, 5000)]
    tracemalloc.start()
    out = sum(r.num_rows for r in tree._forests(rows)(iter(batches)))
    most_held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out <= 4 * rows and most_held < 110 * rows  # 127 * rows when a piece was gathered, then joined into arrays of its own


def test_numbers_come_in_blocks():
    x = np.arange(100)
    assert list(kernels._ints(x, 7)) == x.tolist()


def test_packing_holds_arrays():
    """A long way over the cap with many children is decided on in one task: no lists and objects for each vertex."""
    n, way = 30_000, 1_500
    parent = np.concatenate([n - way + np.minimum(np.random.default_rng(0).geometric(30 / way, n - way), way - 1), np.arange(n - way + 1, n), [-1]])
    weight = np.full(n, 29)
    tracemalloc.start()
    part = kernels.pack_forward(parent, weight, kernels.capacity(29 * n, 2, 1.03))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 100 * n  # 158 * n with lists
    assert np.bincount(part, weights=weight).max() <= kernels.capacity(29 * n, 2, 1.03)
