"""Trees over many ranges: every figure and every partition as one task gives it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graftwork.functions import kernels
from graftwork.operators import facts, limits, partition, tree
from graftwork.operators import ranges as rg
from graftwork.sources import sinks

from .test_graphs import parents_by_definition, random_graph

KINDS = ["comb", "random", "alone"]


def parents(kind, n=60, seed=1):
    rng = random.Random(seed)
    if kind == "path":
        return [v + 1 if v + 1 < n else -1 for v in range(n)]
    if kind == "star":
        return [n - 1] * (n - 1) + [-1]
    if kind == "comb":
        return [v + 2 if v % 2 and v + 2 < n else v + 1 if v % 2 == 0 else -1 for v in range(n)]
    if kind == "two paths":
        return [v + 2 if v + 2 < n else -1 for v in range(n)]
    if kind == "alone":
        return [-1] * n
    return [rng.choice([rng.randrange(v + 1, n), min(n - 1, v + 3), -1 if rng.random() < 0.1 else v + 1]) if v + 1 < n else -1 for v in range(n)]


def frame(spark, parent, weight):
    return spark.createDataFrame([(v, None if p < 0 else p, int(w)) for v, (p, w) in enumerate(zip(parent, weight, strict=True))], "jnid long, parent long, pst_weight long").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(rg, "RANGE_ROWS", 16)


@pytest.mark.parametrize("kind", KINDS)
def test_path_figures(spark, kind):
    parent, weight = parents(kind), np.random.default_rng(2).integers(0, 9, 60)
    want = kernels.path_figures(np.array(parent), weight)
    names = ["depth", "path_weight", "height", "subtree_size", "subtree_weight", "enter"]
    got = tree.path_figures(frame(spark, parent, weight)).select("jnid", *names)
    assert rows(got) == [(v, *(int(want[c][v]) for c in names)) for v in range(60)]


def test_no_task_sees_more_than_a_range(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    one = rg.in_ranges

    def counted(df, run, schema):
        def checked(table):
            assert table.num_rows <= 16
            seen.add(table.num_rows)
            return run(table)

        return one(df, checked, schema)

    monkeypatch.setattr(rg, "in_ranges", counted)
    monkeypatch.setattr(tree, "in_one_task", None)
    tree.path_figures(frame(spark, parents("random"), [1] * 60)).collect()
    assert seen.value >= 120


def test_long_path_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(rg, "RANGE_ROWS", 1 << 13)
    n, stored = 100_000, []
    keep = rg.materialize
    monkeypatch.setattr(rg, "materialize", lambda df, tag: stored.append(tag) or keep(df, tag))
    df = spark.range(n).select(F.col("id").alias("jnid"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("parent"), F.lit(1).cast("long").alias("pst_weight"))
    got = tree.path_figures(df)
    wrong = got.where(f"depth <> {n - 1} - jnid or height <> jnid or subtree_size <> jnid + 1 or enter <> depth or path_weight <> depth + 1").count()
    assert got.count() == n and wrong == 0
    assert max(stored.count("chains"), stored.count("roots")) < 8  # 13 ranges


@pytest.mark.parametrize("size", [7, 1000])
def test_forests(spark, monkeypatch, size):
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    rng = random.Random(size)
    for m in (30, 90):
        pairs = [(a, b) for a, b in random_graph(rng, 40, m) if a != b]
        epos = spark.createDataFrame([(min(p), max(p)) for p in pairs] + [(3, None)], "lo long, hi long").repartition(4)
        seq = spark.range(40).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
        want = [(v, None if p < 0 else p, sum(min(e) == v for e in pairs) + (v == 3)) for v, p in enumerate(parents_by_definition(40, pairs))]
        t = tree.build_tree(epos, seq)
        assert sorted(map(tuple, t.collect())) == want
        assert tuple(tree.validate(t, epos).first()) == (0, 0, 0)


def test_widths(spark):
    rng = random.Random(6)
    for m in (30, 110):
        pairs = [(min(p), max(p)) for p in random_graph(rng, 45, m) if p[0] != p[1]]
        epos = spark.createDataFrame([*pairs, (5, None)], "lo long, hi long").repartition(3)
        seq = spark.range(45).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
        t = tree.build_tree(epos, seq)
        assert rows(tree.widths(t, epos)) == rows(tree.filled(t, epos).select("jnid", "width"))
        f = facts.tree_facts(t, tree.widths(t, epos)).first()
        assert f.fill == sum(w for _, w in rows(tree.widths(t, epos))) - 45 - len(pairs) - 1


def test_least_of_runs(spark):
    rng = random.Random(9)
    line = [rng.choice([None, *range(50)]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(line)), "at long, value long")
    pairs = sorted({(a, rng.randrange(a, 40)) for a in (rng.randrange(40) for _ in range(80))})
    asked = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, n long").repartition(3)
    most = np.iinfo(np.int64).max
    assert rows(tree.least_of(df, asked).select("a", "b", "n", "least")) == [(a, b, 1, min((x for x in line[a : b + 1] if x is not None), default=most)) for a, b in pairs]


def ends(weight, cap, over):
    """Part of each row, one row at a time."""
    out, now, size = [], 0, 0
    for w in weight:
        if over:
            if size + w < cap:
                size += w
            else:
                now, size = now + 1, w
            out.append(now)
        else:
            out.append(now)
            size += w
            if size >= cap:
                now, size = now + 1, 0
    return out


@pytest.mark.parametrize("over", [False, True])
def test_filled(spark, over):
    rng = random.Random(4)
    for cap in (0, 9):
        weight = [rng.choice([0, 0, 1, 3, 12]) for _ in range(50)]
        df = spark.createDataFrame(list(enumerate(weight)), "jnid long, weight long").repartition(3)
        assert rows(partition.filled(df, ["jnid"], cap, over)) == list(enumerate(ends(weight, cap, over)))


@pytest.mark.parametrize(("method", "kind"), [*((m, "random") for m in partition.METHODS), ("backward", "path")])
def test_partitions(spark, monkeypatch, method, kind):
    weight = np.random.default_rng(5).integers(0, 6, 60)
    t, seq = frame(spark, parents(kind), weight), spark.range(60).select(F.col("id").alias("pos"), (F.col("id") + 100).alias("vid"))
    got = rows(partition.tree_partition(t, seq, 5, method, balance=1.2))
    monkeypatch.setattr(rg, "RANGE_ROWS", 1000)
    assert got == rows(partition.tree_partition(t, seq, 5, method, balance=1.2))


def test_forward_by_definition(spark):
    """Parts of random trees as the rule gives them, one vertex at a time."""
    for seed in range(2):
        parent, weight = parents("random", 40, seed), np.random.default_rng(seed).integers(0, 5, 40)
        cap = partition.capacity(int(weight.sum()), 4, 1.1)
        kids = {v: [k for k in range(40) if parent[k] == v] for v in range(40)}
        size, part, rest = [], {}, {}
        for v in range(40):
            rest[v] = int(weight[v]) + sum(rest[k] for k in kids[v])
            while rest[v] > cap:
                for k in sorted((k for k in kids[v] if k not in part), key=lambda k: (-rest[k], k)):
                    fits = [p for p in range(len(size)) if size[p] + rest[k] <= cap]
                    if rest[v] > cap and fits:
                        part[k] = fits[0]
                        size[fits[0]] += rest[k]
                        rest[v] -= rest[k]
                if rest[v] > cap:
                    size.append(0)
        for v in reversed(range(40)):
            if v not in part and parent[v] >= 0:
                part[v] = part[parent[v]]
            elif v not in part:
                fits = [p for p in range(len(size)) if size[p] + rest[v] <= cap]
                if not fits:
                    size.append(0)
                    fits = [len(size) - 1]
                part[v] = fits[-1]
                size[fits[-1]] += rest[v]
        t, seq = frame(spark, parent, weight), spark.range(40).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
        assert dict(rows(partition.tree_partition(t, seq, 4, balance=1.1))) == part


def test_skeleton_is_small(spark):
    parent, weight = parents("random", 200, 3), np.ones(200, int)
    t = partition.weighted(frame(spark, parent, weight))
    bones = partition.skeleton(t, 50).collect()
    figures = kernels.path_figures(np.array(parent), weight)
    heavy = int((figures["subtree_weight"] > 50).sum())
    kids = sum(p >= 0 and figures["subtree_weight"][p] > 50 for p in parent)
    assert len(bones) <= heavy + kids + sum(p < 0 for p in parent) and heavy <= 200 // 50 * (int(figures["height"].max()) + 1)


def test_heavy_vertex(spark):
    t, seq = frame(spark, parents("path"), [50] + [0] * 59), spark.range(60).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
    with pytest.raises(ValueError, match="over the capacity"):
        partition.tree_partition(t, seq, 4)


def test_nearest_labels(spark):
    rng = random.Random(7)
    for kind in ("random", "two paths"):
        parent = parents(kind)
        label = [rng.choice([None, None, None, v % 5]) for v in range(60)]
        df = spark.createDataFrame([(v, None if p < 0 else p, x) for v, (p, x) in enumerate(zip(parent, label, strict=True))], "jnid long, parent long, label long")

        def near(v, parent=parent, label=label):
            while v >= 0 and label[v] is None:
                v = parent[v]
            return label[v] if v >= 0 else None

        assert rows(rg.nearest_label(df, "label")) == [(v, near(v)) for v in range(60)]


@pytest.mark.parametrize("size", [16])
def test_tree_adjacency(spark, monkeypatch, size):
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    rng = random.Random(8)
    pairs = [(min(p), max(p)) for p in random_graph(rng, 40, 60) if p[0] != p[1]]
    epos = spark.createDataFrame(pairs, "lo long, hi long")
    seq = spark.range(40).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
    t = tree.build_tree(epos, seq)
    full = t.join(tree.pre_weights(t, epos), "jnid")
    by = {r.jnid: r for r in full.collect()}
    below = {v: [u for u in by if v in ways(by, u)] for v in by}
    leaving = {v: sum(by[u].pst_weight for u in below[v]) - sum(by[u].pre_weight for u in below[v] if u != v) for v in by}
    cost = {v: min(len(below[v]), leaving[v]) + min(len(ways(by, by[v].parent)), leaving[v]) for v in by if by[v].parent is not None}
    lines = dict(rows(sinks.tree_adjacency(full)))
    assert lines[0] == f"40 {len(cost)} 011"
    for v in by:
        near = [(by[v].parent, cost[v])] if v in cost else []
        near += sorted((k, cost[k]) for k in cost if by[k].parent == v)
        assert lines[v + 1] == " ".join(["1", *(f"{u + 1} {w}" for u, w in near)])


def ways(by, v):
    out = [v]
    while by[out[-1]].parent is not None:
        out.append(by[out[-1]].parent)
    return out


@pytest.mark.parametrize("size", [1 << 18, 8])
def test_width_limit(spark, monkeypatch, size):
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    monkeypatch.setattr(tree, "in_one_task", None)
    rng = random.Random(5)
    for limit in (0, 2, 4):
        pairs = [(rng.randrange(40), min(rng.randrange(40), rng.randrange(40))) for _ in range(70)]
        order = [v for v in rng.sample(range(42), 42) if v % 11 != 3]
        near = {v: [] for v in order}
        for x, y in pairs:
            for a, b in {(x, y), (y, x)}:
                if a in near:
                    near[a].append(b)
        seq = spark.createDataFrame(list(enumerate(order)), "pos long, vid long")
        got = tree.limited(spark.createDataFrame(pairs, "src long, dst long"), seq, limit)
        want = [tuple(r[c] for c in ("jnid", "vid", "parent", "pst_weight", "width")) for r in kernels.limited_tree(near, order, limit, False)]
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("size", "rounds"), [(8, 4), (8, 0), (1 << 18, 1)])
def test_width_limit_with_many_that_wait_for_sure(spark, monkeypatch, size, rounds):
    """Low vertices meet a few high ones, as suppliers and parts do; whoever waits for sure isn't settled one by one, however many of them are found first."""
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    monkeypatch.setattr(limits, "SURE_ROUNDS", rounds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        rng = random.Random(6)
        pairs = [(v, 60 + rng.randrange(10)) for v in range(60) for _ in range(1 + v // 10)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(9)]
        order = [v for v in range(70) if v not in (7, 69)]
        near = {v: [] for v in order}
        for x, y in pairs:
            for a, b in {(x, y), (y, x)}:
                if a in near:
                    near[a].append(b)
        seq = spark.createDataFrame(list(enumerate(order)), "pos long, vid long")
        got = tree.limited(spark.createDataFrame(pairs, "src long, dst long"), seq, 4)
        want = [tuple(r[c] for c in ("jnid", "vid", "parent", "pst_weight", "width")) for r in kernels.limited_tree(near, order, 4, False)]
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_who_waits_for_sure_depends_on_none_of_the_others(spark):
    epos = spark.createDataFrame([(0, 3), (0, 4), (0, 5), (1, 3), (1, 4), (1, 5), (2, 5), (3, 4), (3, 5)], "lo long, hi long")
    sure = limits.surely_waiting(epos, 5, 2)
    assert np.flatnonzero(sure.has(np.arange(7))).tolist() == [0, 1, 3, 4]
    assert sure.before(np.arange(5)).tolist() == [0, 1, 2, 2, 3]


def test_ranges_settled_at_once():
    assert limits.levels([(0, 3), (1, 3), (2, 4)], 5) == [[0, 1, 2], [3, 4]]
    assert limits.levels([(0, 1), (0, 2)], 3) == [[0], [1], [2]]


def test_a_long_chain_has_no_sets():
    order = list(range(3000))
    tracemalloc.start()
    rows_ = kernels.limited_tree({v: [u for u in (v - 1, v + 1) if 0 <= u < 3000] for v in order}, order, 0, False)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert [r["width"] for r in rows_] == list(range(3000, 0, -1))


def test_a_large_partition_is_held_piece_by_piece(monkeypatch):
    most = []
    one = kernels.forest
    monkeypatch.setattr(kernels, "forest", lambda los, his, n: most.append(len(los)) or one(los, his, n))
    batches = [pa.record_batch([pa.array(np.arange(k, k + 10)), pa.array(np.arange(k + 1, k + 11)), pa.array(np.ones(10, np.int64))], ["lo", "hi", "w"]) for k in range(0, 100, 10)]
    got = pa.Table.from_batches(tree._forests(20)(iter(batches)))
    assert most == [20] * 5 and sum(got["w"].to_pylist()) == 100 and got["hi"].to_pylist() == [v + 1 for v in got["lo"].to_pylist()]


def test_a_block_that_is_asked_often_has_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(tree, "ASKED_ROWS", 10)
    rng = random.Random(3)
    line = [rng.randrange(100) for _ in range(40)]
    pairs = sorted({tuple(sorted((rng.randrange(40), rng.randrange(40)))) for _ in range(90)})
    got = tree.least_of(spark.createDataFrame(list(enumerate(line)), "at long, value long"), spark.createDataFrame([(*p, 1) for p in pairs], "a long, b long, n long"))
    assert rows(got) == [(a, b, 1, min(line[a : b + 1])) for a, b in pairs]
    monkeypatch.setattr(tree, "materialize", lambda df, tag: df)
    one = type(spark.range(0)).repartitionById
    dealt = []
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda df, n, c: dealt.append(n) or one(df, n, c))
    tree.least_of(spark.createDataFrame(list(enumerate(line)), "at long, value long"), spark.createDataFrame([(*p, 1) for p in pairs], "a long, b long, n long"))
    assert dealt[0] >= len(pairs) // 10


@pytest.mark.parametrize("asked", [7, 1 << 20])
def test_filled_edges(spark, monkeypatch, asked):
    monkeypatch.setattr(tree, "ASKED_ROWS", asked)
    monkeypatch.setattr(tree, "in_one_task", None)
    rng = random.Random(asked)
    pairs = [(min(p), max(p)) for p in random_graph(rng, 45, 70) if p[0] != p[1]]
    epos = spark.createDataFrame([*pairs, (5, None)], "lo long, hi long").repartition(3)
    seq = spark.range(45).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
    t = tree.build_tree(epos, seq)
    up = {r.jnid: rg.NONE if r.parent is None else r.parent for r in t.collect()}
    want = kernels.filled_neighbours(np.array([up[v] for v in range(45)]), [{b for a, b in pairs if a == v} for v in range(45)])
    assert [(r.jnid, r.jxn, r.width) for r in tree.filled(t, epos).orderBy("jnid").collect()] == [(v, x, 1 + len(x)) for v, x in enumerate(want)]


@pytest.mark.parametrize("rows_", [5, 1 << 22])
def test_passes_go_on_where_the_last_one_ended(spark, monkeypatch, rows_):
    monkeypatch.setattr(partition, "PASS_ROWS", rows_)
    monkeypatch.setattr(partition, "_PIECE", 100)
    monkeypatch.setattr(partition, "in_one_task", None)
    pairs = [(a, b) for a, b in random_graph(random.Random(4), 12, 20)]
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    at = {v: i for i, v in enumerate(sorted({v for p in pairs for v in p}))}
    n = len(at)
    x, y = (np.array([at[v] for v in c]) for c in zip(*sorted(pairs), strict=True))
    want = kernels.EdgeStream(n, len(pairs), 3, 1.03).take(x, y)[0].tolist()
    assert sorted(map(tuple, partition.stream_edges(edges, 3).collect())) == sorted((*p, part) for p, part in zip(sorted(pairs), want, strict=True))
    whole = dict(map(tuple, partition.stream_vertices(edges, 3).collect()))
    monkeypatch.setattr(partition, "PASS_ROWS", 1 << 22)
    assert len(whole) == n and whole == dict(map(tuple, partition.stream_vertices(edges, 3).collect()))


@pytest.mark.parametrize("size", [1 << 18, 8])
def test_filled_graph_block_by_block(spark, monkeypatch, size):
    """Edges may repeat; no table of edges is made, but pieces of lists, whatever the blocks."""
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    monkeypatch.setattr(tree, "ASKED_ROWS", 5)
    monkeypatch.setattr(tree, "_HELD", 20)
    for seed in range(2):
        rng = random.Random(seed)
        pairs = [(min(p), max(p)) for p in random_graph(rng, 45, 70) if p[0] != p[1]]
        pairs += [(a, 44) for a in range(0, 44, 5)] if seed else pairs[:9]
        epos = spark.createDataFrame([*pairs, (5, None)], "lo long, hi long").repartition(3)
        t = tree.build_tree(epos, spark.range(45).select(F.col("id").alias("pos"), F.col("id").alias("vid")))
        up = {r.jnid: rg.NONE if r.parent is None else r.parent for r in t.collect()}
        want = kernels.filled_neighbours(np.array([up[v] for v in range(45)]), [{b for a, b in pairs if a == v} for v in range(45)])
        got = [(r.jnid, u) for r in tree.filled_pieces(t, epos).collect() for u in r.laters]
        assert sorted(got) == [(v, u) for v, x in enumerate(want) for u in x]
        assert [(r.jnid, r.jxn, r.width) for r in tree.filled(t, epos).orderBy("jnid").collect()] == [(v, x, 1 + len(x)) for v, x in enumerate(want)]


@pytest.mark.parametrize("size", [1 << 18, 8])
def test_sums_of_the_filled_graph_without_it(spark, monkeypatch, size):
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    monkeypatch.setattr(tree, "ASKED_ROWS", 5)
    monkeypatch.setattr(tree, "_follow", None)
    rng = random.Random(size)
    pairs = [(min(p), max(p)) for p in random_graph(rng, 45, 70) if p[0] != p[1]]
    pairs += [(a, 44) for a in range(0, 44, 5)] + pairs[:9]
    epos = spark.createDataFrame([*pairs, (5, None)], "lo long, hi long").repartition(3)
    t = tree.build_tree(epos, spark.range(45).select(F.col("id").alias("pos"), F.col("id").alias("vid")))
    up = {r.jnid: rg.NONE if r.parent is None else r.parent for r in t.collect()}
    want = kernels.filled_neighbours(np.array([up[v] for v in range(45)]), [{b for a, b in pairs if a == v} for v in range(45)])
    assert rows(tree.filled_sums(t, epos)) == [(v, 1 + len(x), sum(x)) for v, x in enumerate(want)]


@pytest.mark.parametrize("rows_", [1, 10000])
def test_damaged_filled_graph(spark, monkeypatch, rows_):
    """Lists stream past their parents', batch by batch; a parent of many goes to several tasks."""
    monkeypatch.setattr(tree, "KIDS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)
    try:
        for seed in range(3):
            rng = random.Random(seed)
            up = [rng.choice([None, *([min(39, v + rng.randrange(1, 9)), 38 if v < 38 else 39] if v < 39 else [])]) for v in range(40)]
            jxn = [sorted(rng.sample(range(40), rng.randrange(6))) for _ in up]
            for v, p in enumerate(up):
                if p is not None and rng.random() < 0.7:
                    jxn[v] = [p, *rng.sample(jxn[p], min(2, len(jxn[p])))]
            first = sum((x[0] if x else None) != p for x, p in zip(jxn, up, strict=True))
            subset = sum(p is not None and bool({*x} - {*jxn[p], p}) for x, p in zip(jxn, up, strict=True))
            t = spark.createDataFrame([(v, p, 1) for v, p in enumerate(up)], "jnid long, parent long, pst_weight long")
            lists = spark.createDataFrame([(v, x, 1 + len(x)) for v, x in enumerate(jxn)], "jnid long, jxn array<long>, width long")
            assert tuple(tree.validate_filled(t, lists).first()) == (first, subset)
        assert tuple(tree.validate_filled(t.limit(0), lists.limit(0)).first()) == (0, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
