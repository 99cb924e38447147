"""Hard negatives and clusters against brute force, on awkward rows, with chunks and trees so small that there are many."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftwork.llm import clusters, negatives

LONG = (-(2**63), 2**63 - 1)


def whole(vector, scale):
    """Components as whole numbers; None if the vector takes no part."""
    if not vector or any(x is None or not math.isfinite(x * scale) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def cut(x):
    return max(LONG[0], min(LONG[1], x))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def mined(data, step, n_pos=5, n_neg=10, scale=256.0):
    v = [(i, x, label) for i, e, label in data if i is not None and label is not None and (x := whole(e, scale)) is not None]
    out = []
    for a, x, label in v:
        if a % step:
            continue
        ranked = sorted(((cut(sum(p * q for p, q in zip(x, y, strict=True))), i, m) for i, y, m in v if i != a and len(y) == len(x)), key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [t for t in ranked if t[2] == label][:n_pos]:
            for r, (ns, n, _) in enumerate([t for t in ranked if t[2] != label and 30 * ps <= 100 * t[0] <= 90 * ps][:n_neg], 1):
                out.append((a, p, r, n, ps, ns))
    return sorted(out, key=str)


def clustered(data, k, dim, rounds=3, scale=64.0):
    kept = [(i, x) for i, e, *_ in data if (x := whole(e, scale)) is not None and len(x) == dim]
    c = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min(range(len(c)), key=lambda j: (apart(x, c[j]), j))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(x) for _, x in kept]
    d = [min(apart(x, c[o]), LONG[1]) for (_, x), o in zip(kept, own, strict=True)]
    of = {j: cut(sum(y for y, o in zip(d, own, strict=True) if o == j)) for j in range(len(c))}
    return sorted(((i, o, y, of[o], cut(sum(d)), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, y in zip(kept, own, d, strict=True)), key=str)


def awkward():
    rng = random.Random(1)
    data = [(i % 290, [rng.choice([0.0, 1.0, -2.0, 5.5]) * rng.choice([1, 1, 1, 7]) for _ in range(rng.choice([3, 3, 3, 2]))], rng.choice([0, 0, 0, 1, 2])) for i in range(300)]
    data += [(None, [1.0] * 3, 1), (7, None, 1), (8, [1.0, None, 2.0], 1), (9, [1.0] * 3, None), (9, [float("nan"), 1.0, 1.0], 2), (11, [1.0, float("inf"), 1.0], 2), (401, [], 2), (5, [0.0] * 3, 1), (5, [0.0] * 3, 1)]
    return data + [(500 + i, [4.0, 4.0, 4.0], 0) for i in range(60)]


HUGE = [(400, [1e30, -1e30, 3.0], 1), (402, [1e30, -1e30, 3.0], 1), (405, [4e29, -4e29, 3.0], 2), (403, [2e15, 1.0, 0.0], 1), (406, [1e3, 1.0, 0.0], 2)]


def frame(spark, data):
    names = ["q", "id", "x", "norm", "bucket", "kth", "v", "rank", "cluster", "tree", "distance"]
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["extra"] * len(names)) for r in data], schema).repartition(3)


@pytest.mark.parametrize("data", [awkward(), awkward() + HUGE])
def test_hard_negatives(spark, monkeypatch, data):
    for name, value in (("CHUNK", 16), ("BLOCK", 4), ("BUCKETS", 12), ("QUERY_BLOCK", 5), ("TOGETHER", 3), ("WAVE", 2)):
        monkeypatch.setattr(negatives, name, value)
    got = negatives.mine(frame(spark, data), F.col("vec_id") % 5 == 0, F.col("label"))
    want = mined(data, 5)
    assert len(want) > 1000 and rows(got) == want


def test_hard_negatives_of_nothing(spark):
    df = frame(spark, awkward())
    assert negatives.mine(df.where("vec_id < 0"), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0
    assert negatives.mine(df, F.lit(False), F.col("label")).count() == 0
    assert negatives.mine(df.where("label = 1"), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0
    with pytest.raises(ValueError, match="window"):
        negatives.mine(df, F.lit(True), F.col("label"), window=(90, 30))


def test_length_bound_leaves_blocks_out():
    """Short candidates can't reach the k-th score: only the first block is scored."""
    x = np.array([[100.0, 0.0]] * 10 + [[1.0, 0.0]] * 1000)
    chunk = negatives.Chunk(np.arange(len(x)), np.zeros(len(x), np.int64), x, np.linalg.norm(x, axis=1))
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, item):
            if isinstance(item, slice):
                seen.append(item.start)
            return np.ndarray.__getitem__(self, item)

    chunk.x = chunk.x.view(Counted)
    asked = {"ids": np.array([-1]), "labels": np.array([0]), "x": np.array([[2.0, 0.0]]), "norms": np.array([2.0]), "lo": np.array([[-np.inf]]), "hi": np.array([[np.inf]]), "kth": np.array([[-np.inf]])}
    _, _, s, v = chunk.best(asked, 5, same=True)
    assert s.tolist() == [200.0] * 5 and v.tolist() == [0, 1, 2, 3, 4] and set(seen) == {0}


@pytest.mark.parametrize("data", [awkward(), awkward() + HUGE])
@pytest.mark.parametrize("k", [1, 4, 16])
def test_clusters(spark, data, k):
    assert rows(clusters.cluster(frame(spark, data), k=k, dim=3, tree_rows=40)) == clustered(data, k, 3)


def test_clusters_of_few_and_of_nothing(spark):
    df = frame(spark, awkward())
    assert clusters.cluster(df.where("vec_id < 0")).count() == 0
    few = [(1, [0.5, 0.25], 0), (2, [3.0, 1.0], 0)]
    assert rows(clusters.cluster(frame(spark, few), dim=2)) == clustered(few, 16, 2)
    assert rows(clusters.cluster(frame(spark, [(None, [0.5, 0.25], 0)]), dim=2)) == clustered([(None, [0.5, 0.25], 0)], 16, 2)


def test_nodes_are_assigned_as_a_whole_and_dominated_centroids_go():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [1000, 0, 0], [0, 1000, 0], [1000, 1000, 1000]], float)
    x = np.concatenate([c + rng.integers(-20, 20, (500, 3)) for c in centres])
    tree = clusters.plant(x, leaf_rows=16)
    node, of_node, row, of_row = clusters.walk(tree | {"x": tree["x"].astype(float)}, centres)
    assert not len(row) and len(node) < 30
    own = np.empty(len(x), int)
    for (a, b), k in zip(tree["rows"][node], of_node, strict=True):
        own[a:b] = k
    assert (own == ((tree["x"][:, None] - centres[None]) ** 2).sum(-1).argmin(1)).all()


def test_equal_distances_go_to_the_smaller_number():
    tree = clusters.plant(np.array([[0.0], [1.0], [2.0], [3.0]]), leaf_rows=1)
    node, of_node, row, of_row = clusters.walk(tree, np.array([[2.0], [0.0], [2.0]]))
    own = dict(zip(row.tolist(), of_row.tolist(), strict=True)) | {r: k for (a, b), k in zip(tree["rows"][node].tolist(), of_node.tolist(), strict=True) for r in range(a, b)}
    by = {tree["x"][r, 0]: k for r, k in own.items()}
    assert by == {0.0: 1, 1.0: 0, 2.0: 0, 3.0: 0}
