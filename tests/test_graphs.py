"""Graph operators: golden values, small graphs by hand, random graphs against definitions."""

import random
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graftwork import catalogue
from graftwork.functions import kernels
from graftwork.functions.hashes import golden_hash, parity_hash, prime_hash
from graftwork.operators import evaluate as ev
from graftwork.operators import facts, partition, sequence, tree
from graftwork.operators import ranges as rg
from graftwork.plans import partitioning
from graftwork.sources import graphs, sinks
from graftwork.streaming.forests import keep_tree

SF = "/root/testdata/sf0.01"


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def parents_by_definition(n, pairs):
    """The first later vertex that is reached through vertices up to v."""
    near = [set() for _ in range(n)]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = []
    for v in range(n):
        seen, todo, later = {v}, [v], []
        while todo:
            for u in near[todo.pop()] - seen:
                seen.add(u)
                (later if u > v else todo).append(u)
        out.append(min(later, default=-1))
    return out


def forest(n, pairs):
    f = kernels.Forest()
    for lo, hi in sorted(((min(p), max(p)) for p in pairs if p[0] != p[1]), key=lambda p: p[1]):
        f.edge(lo, hi)
    return [f.parent.get(v, -1) for v in range(n)]


def random_graph(rng, n=12, m=20):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_forest_is_that_of_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        pairs = random_graph(rng, rng.randint(1, 20), rng.randint(0, 45))
        n = 20
        assert forest(n, pairs) == parents_by_definition(n, [p for p in pairs if p[0] != p[1]])


def test_forests_merge():
    rng = random.Random(2)
    for _ in range(200):
        pairs, n = random_graph(rng, 15, 40), 15
        cut = [[p for p in pairs if rng.random() < 0.5] for _ in range(3)]
        cut.append([p for p in pairs if all(p not in c for c in cut)])
        partial = [(v, p) for c in cut for v, p in enumerate(forest(n, c)) if p >= 0]
        assert forest(n, partial) == forest(n, pairs)


@pytest.fixture(scope="module")
def golden(spark):
    edges = graphs.supplier_part(spark, SF).cache()
    return partitioning.graph_to_tree(edges, check=True, with_facts=True)


def test_golden_tree(golden):
    t = golden.tree.where("parent is not null").agg(F.count("*"), F.sum(7 * F.col("jnid") + F.col("parent"))).first()
    assert tuple(t) == (2099, 19622214)
    f = golden.facts.first()
    assert (f.vert_cnt, f.edge_cnt, f.width, f.fill, f.vert_height, f.edge_height, f.root_cnt, f.halo_id) == (2100, 51731, 42, 0, 101, 41, 1, 0)
    assert tuple(golden.valid.first()) == (0, 0, 0)


@pytest.mark.parametrize(("where", "count", "check"), [("src <= 30 and dst <= 1000060", 91, 34506), ("src <= 100 and dst <= 1000300", 400, 685035)])
def test_golden_small_trees(spark, where, count, check):
    run = partitioning.graph_to_tree(graphs.supplier_part(spark, SF).where(where))
    assert tuple(run.tree.where("parent is not null").agg(F.count("*"), F.sum(7 * F.col("jnid") + F.col("parent"))).first()) == (count, check)


def test_golden_partitions(golden):
    want = {
        2: ([25103, 26628], (24161, 1052, 1144, 1027, 38841, 98, 26628, 826, 50789)),
        4: ([13319, 13319, 13305, 11788], (38401, 2539, 577, 2310, 30751, 292, 13319, 2089, 49330)),
        8: ([6659, 6659, 6657, 6659, 6659, 6648, 6473, 5317], (45074, 4679, 313, 3403, 27369, 680, 6659, 3432, 47862)),
    }
    partitioning.partition_tree(golden, [2, 4, 8])
    for k, (sizes, costs) in want.items():
        owned = dict(rows(ev.assign_edges(golden.edges, golden.parts[k], golden.seq).groupBy("part").count()))
        assert [owned[p] for p in range(len(sizes))] == sizes
        e = golden.evaluation[k].first()
        assert (e.edges_cut, e.vcom_vol, e.vertex_bal, e.ecv_hash, e.hash_bal, e.ecv_down, e.down_bal, e.ecv_up, e.up_bal) == costs


def test_other_partitions_cover_all(golden):
    for method in ("backward", "depth", "height", "naive"):
        parts = partition.tree_partition(golden.tree, golden.seq, 4, method)
        assert parts.count() == 2100 and parts.where("part is null or part < 0").count() == 0
    weighted = partition.tree_partition(golden.tree, golden.seq, 4, vertex_weight=True, pre_weight=tree.pre_weights(golden.tree, tree.positioned(golden.edges, golden.seq)))
    assert weighted.count() == 2100


def test_micro_graphs(spark):
    cases = {
        "path": ([(0, 1), (1, 2), (2, 3)], 4), "star": ([(9, i) for i in range(5)], 6), "k5": ([(a, b) for a in range(5) for b in range(a)], 5),
        "two": ([(0, 1), (5, 6)], 4), "loop and edge": ([(3, 3), (3, 4)], 2), "repeated": ([(0, 1), (1, 0), (0, 1)], 2), "loop": ([(3, 3)], 1), "empty": ([], 0),
    }
    for name, (pairs, n) in cases.items():
        run = partitioning.graph_to_tree(edges_of(spark, pairs), check=True)
        seq = {v: p for p, v in rows(run.seq)}
        assert len(seq) == n, name
        got = {r.jnid: (-1 if r.parent is None else r.parent, r.pst_weight) for r in run.tree.collect()}
        pos = [(seq[a], seq[b]) for a, b in pairs if a != b]
        assert [got[v][0] for v in range(n)] == parents_by_definition(n, pos), name
        assert [got[v][1] for v in range(n)] == [sum(min(p) == v for p in pos) for v in range(n)], name
        assert tuple(run.valid.first()) == (0, 0, 0), name


def test_user_sequence(spark):
    """A sequence may leave out a vertex, which then counts as later, and have one that the graph hasn't."""
    edges = edges_of(spark, [(1, 2), (2, 3), (1, 3)])
    seq = spark.createDataFrame([(0, 1), (1, 7), (2, 2)], "pos long, vid long")
    t = tree.build_tree(tree.positioned(edges, seq), seq)
    assert rows(t) == [(0, 2, 2), (1, None, 0), (2, None, 1)] or rows(t.select("jnid", "pst_weight")) == [(0, 2), (1, 0), (2, 1)]


def test_filled_graph_and_weights(spark):
    rng = random.Random(4)
    pairs = [p for p in random_graph(rng, 14, 40) if p[0] != p[1]]
    run = partitioning.graph_to_tree(edges_of(spark, pairs))
    epos = tree.positioned(run.edges, run.seq)
    e = [tuple(r) for r in epos.select("lo", "hi").collect()]
    parent = {r.jnid: r.parent for r in run.tree.collect()}
    near = {v: set() for v in parent}
    for a, b in e:
        near[a].add(b)
    for v in sorted(parent):  # eliminate v: its later neighbours become neighbours
        later = sorted(near[v])
        for a, b in zip(later, later[1:], strict=False):
            near[a].add(b)
        if later:
            near[later[0]] |= set(later[1:])
    jxn = {r.jnid: (list(r.jxn), r.width) for r in tree.filled(run.tree, epos).collect()}
    assert jxn == {v: (sorted(x), 1 + len(x)) for v, x in near.items()}

    def below(v, top):
        while v is not None and v != top:
            v = parent[v]
        return v == top

    pre = dict(rows(tree.pre_weights(run.tree, epos)))
    assert pre == {v: sum(below(a, v) and b == p for a, b in e) if p is not None else 0 for v, p in parent.items()}
    f = facts.tree_facts(run.tree, tree.filled(run.tree, epos)).first()
    assert f.fill == sum(map(len, near.values())) - len(e)
    for limit in (1, 3, None):
        got = tree.limited(run.edges, run.seq, limit).collect()
        assert sorted(r.vid for r in got) == sorted(r.vid for r in run.seq.collect())
        assert all(r.parent is None or r.parent > r.jnid for r in got)
        if limit is None:
            assert {r.jnid: r.parent for r in got} == parent and {r.jnid: r.width for r in got} == {v: x[1] for v, x in jxn.items()}
    assert tree.limited(run.edges, run.seq, find_max_width=True).agg(F.max("width")).first()[0] == max(x[1] for x in jxn.values())


def test_heavy_vertex_is_refused():
    with pytest.raises(ValueError, match="over the capacity"):
        kernels.pack_forward(np.array([1, -1]), np.array([10, 0]), 5)


def test_more_parts_than_edges(spark):
    edges = edges_of(spark, [(0, 1)])
    e = ev.evaluate(edges, spark.createDataFrame([(0, 0), (1, 1)], "vid long, part int"), sequence.degree_sequence(edges), 5).first()
    assert e.vertex_bal_ratio is None and e.down_bal_ratio is None and e.edges_cut == 1 and e.vcom_vol == 2


def test_hashes(spark):
    ids = [0, 1, 12345, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "x long").select("x", golden_hash(F.col("x")), prime_hash(F.col("x")), parity_hash(F.col("x")))
    assert rows(df) == sorted((i, i * 2654435769 % 2**32, i * 2654435761 % 2**32, i % 2) for i in ids)


def test_stream_partitioners(spark):
    edges = edges_of(spark, [(a, b) for c in (0, 10) for a in range(c, c + 6) for b in range(c, a)])
    parts = dict(rows(partition.stream_vertices(edges, 2)))
    assert len({parts[v] for v in range(6)}) == 1 and len(parts) == 12
    by_edge = partition.stream_edges(edges, 2)
    assert by_edge.count() == 30 and by_edge.groupBy("part").count().agg(F.max("count")).first()[0] <= 15
    assert dict(rows(partition.round_robin(edges, 3).groupBy("part").count())) == {0: 10, 1: 10, 2: 10}


def test_files(spark, tmp_path):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4)]
    (tmp_path / "g.net").write_text("".join(f"{a} {b}\n" for a, b in pairs))
    (tmp_path / "g.dat").write_bytes(b"".join(struct.pack("<IIf", a, b, 1.0) for a, b in pairs))
    for name in ("g.net", "g.dat"):
        assert rows(graphs.read_edges(spark, str(tmp_path / name))) == sorted(pairs)  # the last one once
    edges = graphs.read_edges(spark, str(tmp_path / "g.net"))
    assert sorted(sum((rows(graphs.read_edges(spark, str(tmp_path / "g.net"), i, 3)) for i in range(3)), [])) == sorted(pairs)
    sinks.write_binary_edges(edges, str(tmp_path / "h.dat"))
    assert rows(graphs.read_edges(spark, str(tmp_path / "h.dat"))) == sorted(pairs)
    assert {bytes(r.record) for r in sinks.edge_records(edges).collect()} == {struct.pack("<IIf", a, b, 1.0) for a, b in pairs}
    run = partitioning.graph_to_tree(edges)
    sinks.write_sequence(run.seq, str(tmp_path / "seq"))
    assert rows(graphs.read_sequence(spark, str(tmp_path / "seq"))) == rows(run.seq)
    sinks.write_binary_sequence(run.seq, str(tmp_path / "seq.bin"))
    assert rows(graphs.read_sequence(spark, str(tmp_path / "seq.bin"), binary=True)) == rows(run.seq)
    sinks.write_tree(run.tree, str(tmp_path / "t.tre"))
    assert [tuple(r) for r in graphs.read_tree(spark, str(tmp_path / "t.tre")).orderBy("jnid").collect()] == [tuple(r) for r in run.tree.orderBy("jnid").collect()]
    parts = partition.hash_partition(edges, 2)
    sinks.write_partition(parts, run.seq, str(tmp_path / "parts"))
    assert rows(graphs.read_partition(spark, str(tmp_path / "parts"), run.seq)) == rows(parts)
    sinks.write_text_edges(edges, str(tmp_path / "out"))
    assert rows(graphs.read_text_edges(spark, str(tmp_path / "out"))) == sorted(pairs)
    whole = partitioning.distributed_partition(spark, str(tmp_path / "g.net"), [2], out=str(tmp_path / "cut"))
    assert spark.read.text(str(tmp_path / "cut" / "2")).count() == len(pairs) and whole.evaluation[2].count() == 1


def test_relabelled_edges(spark):
    edges = edges_of(spark, [(5, 6), (6, 7), (7, 5), (7, 8)])
    seq = sequence.degree_sequence(edges)
    iso = rows(ev.isomorphic(edges, partition.hash_partition(edges, 2), seq))
    degree = lambda p: sorted(sum(v in x for x in p) for v in {u for x in p for u in x})
    assert all(a < b for a, b in iso) and degree(iso) == degree(rows(edges))


def test_adjacency_of_tree(spark):
    run = partitioning.graph_to_tree(edges_of(spark, [(0, 1), (1, 2)]))
    epos = tree.positioned(run.edges, run.seq)
    lines = [r.value for r in sinks.tree_adjacency(run.tree.join(tree.pre_weights(run.tree, epos), "jnid")).orderBy("line").collect()]
    assert lines[0] == "3 2 011" and all(x.startswith("1 ") for x in lines[1:])
    assert [r.value for r in sinks.tree_dot(run.tree).orderBy("line").collect()][0] == "digraph {"


def test_stream_of_edges(spark, tmp_path):
    rng = random.Random(8)
    pairs = sorted({(a, b) for a, b in random_graph(rng, 20, 50) if a != b})
    (tmp_path / "in").mkdir()
    for i in range(3):
        pd.DataFrame(pairs[i::3], columns=["src", "dst"]).to_parquet(tmp_path / "in" / f"{i}.parquet")
    seq = sequence.degree_sequence(edges_of(spark, pairs))
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_tree(stream, seq, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    want = tree.build_tree(tree.positioned(edges_of(spark, pairs), seq), seq)
    assert rows(spark.read.parquet(str(tmp_path / "state" / "version=2"))) == rows(want)


def pack_streamed(edges, n, k, balance=1.03):
    """One pass over edges, by the definition: most known ends, less what the part's growth costs; lowest part first."""
    m = len(edges)
    cap, a = max(1, int((m // k) * balance)), n * (k / m) ** 1.5
    size, knows, out = [0] * k, [set() for _ in range(k)], []
    for x, y in edges:
        first_empty = next((p for p in range(k) if not size[p]), k - 1)
        fits = [p for p in range(first_empty + 1) if size[p] + 1 <= cap]
        score = {p: (x in knows[p]) + (y in knows[p]) - a * ((size[p] + 1) ** 1.5 - size[p] ** 1.5) for p in fits}
        best = max(fits, key=lambda p: (score[p], -p)) if fits else size.index(min(size))
        size[best] += 1
        knows[best] |= {x, y}
        out.append(best)
    return out


def test_stream_of_edges_by_definition(spark):
    rng = random.Random(11)
    for k in (2, 3):
        pairs = sorted({(a, b) for a, b in random_graph(rng, 15, 60) if a != b})
        got = {(r.src, r.dst): r.part for r in partition.stream_edges(edges_of(spark, pairs), k).collect()}
        assert [got[e] for e in pairs] == pack_streamed(pairs, len({v for e in pairs for v in e}), k)


def test_rooted_tree_is_closed_by_a_chain(spark):
    run = partitioning.graph_to_tree(edges_of(spark, [(0, 1), (1, 2), (0, 2), (7, 8)]))
    got = {r.jnid: r.parent for r in tree.limited(run.edges, run.seq, rooted=True).collect()}
    assert len(got) == 5 and sum(p is None for p in got.values()) == 1


def test_forests_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(rg, "RANGE_ROWS", 20)
    rng = random.Random(12)
    pairs = [(a, b) for a, b in random_graph(rng, 60, 300) if a != b]
    epos = spark.createDataFrame([(min(p), max(p)) for p in pairs], "lo long, hi long").repartition(20)
    seq = spark.range(60).select(F.col("id").alias("pos"), F.col("id").alias("vid"))
    want = sorted((v, None if p < 0 else p, sum(min(e) == v for e in pairs)) for v, p in enumerate(parents_by_definition(60, pairs)))
    forests = tree.partial_forests(epos.withColumn("w", F.lit(1).cast("long")))
    assert sorted(map(tuple, tree.attach(tree.reduce_forests(forests, 59), seq).collect())) == want


NEW = [n for n in catalogue.ORACLE_SQL if n.endswith("file") or n.endswith("files")] + ["gp_tree", "gp_tree_merged", "gp_depth", "gp_height", "gp_backward", "gp_vfennel_k4", "gp_tree_metis_adj", "gp_tree_max_width", "gp_tree_validate_damaged", "gp_jxn_validate_damaged", "gp_pre_weight", "gp_heights", "gp_tree_rooted", "gp_omitted_vertices_tree", "gp_partial_loads", "gp_partial_trees", "gp_fill", "gp_widths", "gp_forward_bounds_k4", "gp_efennel_bounds_k4"]


@pytest.mark.parametrize("name", NEW)
def test_query_as_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(catalogue.ORACLE_SQL[name]).to_arrow_table().select(columns).to_pylist()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(str(tuple(r.values())) for r in want)


def test_tree_file_with_pre_weights(spark, tmp_path):
    run = partitioning.graph_to_tree(graphs.supplier_part(spark, "/root/testdata/sf0.001"))
    full = run.tree.join(tree.pre_weights(run.tree, tree.positioned(run.edges, run.seq)), "jnid")
    sinks.write_tree(full, str(tmp_path / "t.tre"))
    assert sorted(map(str, map(tuple, graphs.read_tree(spark, str(tmp_path / "t.tre"), pre_weight=True).collect()))) == sorted(map(str, map(tuple, full.select("jnid", "parent", "pst_weight", "pre_weight").collect())))


def test_options_of_a_run(spark):
    edges = edges_of(spark, [(a, b) for a in range(6) for b in range(a)] + [(0, 9), (9, 8)])
    run = partitioning.graph_to_tree(edges, widths=True, with_facts=True, check=True, with_kids=True, with_later=True)
    assert tuple(run.valid.first()) == (0, 0, 0, 0, 0) and run.facts.first().width == 6 and run.later.count() == 7
    assert dict(rows(run.kids.select("jnid", F.size("kids")))) == dict(rows(run.tree.where("parent is not null").groupBy("parent").count()))
    limited = partitioning.graph_to_tree(edges, widths=True, with_facts=True, width_limit=3)
    assert limited.tree.count() == 8 and limited.facts.first().vert_cnt == 8
    assert partitioning.graph_to_tree(edges, find_max_width=True).tree.count() < 8
    assert partitioning.graph_to_tree(edges, rooted=True).tree.where("parent is null").count() == 1
