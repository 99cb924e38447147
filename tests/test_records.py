"""Binary records and shares of files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from graftwork.operators import sequence, tree
from graftwork.plans import partitioning
from graftwork.sources import graphs, records, sinks

from .test_graphs import edges_of, rows


def test_round_trips_beyond_31_bits(spark, tmp_path):
    top = 2**32 - 2
    edges = spark.createDataFrame([(1, 7, 0.5), (top, 0, 2.0), (2**31, 3, -1.0)], "src long, dst long, weight float")
    sinks.write_binary_edges(edges, f"{tmp_path}/g.dat")
    assert rows(graphs.read_binary_edges(spark, f"{tmp_path}/g.dat")) == rows(edges)
    seq = spark.range(500).select(F.col("id").alias("pos"), (F.lit(top) - F.col("id") * 3).alias("vid")).repartition(7)
    sinks.write_binary_sequence(seq, f"{tmp_path}/s")
    data = (tmp_path / "s").read_bytes()
    assert data == struct.pack("<Q500I", 500, *(top - 3 * i for i in range(500)))
    assert rows(graphs.read_sequence(spark, f"{tmp_path}/s", binary=True)) == rows(seq)
    t = spark.range(300).select(F.col("id").alias("jnid"), F.when(F.col("id") < 299, F.col("id") + 1).alias("parent"), (F.col("id") * 7).alias("pst_weight")).repartition(5)
    sinks.write_tree(t, f"{tmp_path}/t")
    assert (tmp_path / "t").read_bytes()[:12] == struct.pack("<III", 300, 1, 0) and (tmp_path / "t").read_bytes()[-8:] == struct.pack("<II", 0xFFFFFFFF, 299 * 7)
    assert rows(graphs.read_tree(spark, f"{tmp_path}/t").where("parent is not null")) == rows(t.where("parent is not null"))
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


@pytest.mark.parametrize("pair", [(1, 2**32 + 7), (-3, 5), (2**32 - 1, 5)])
def test_ids_that_no_record_holds(spark, tmp_path, pair):
    with pytest.raises(Exception, match="a record holds 0 to|no record holds"):
        sinks.write_binary_edges(edges_of(spark, [pair]), f"{tmp_path}/g.dat")
    with pytest.raises(Exception, match="no record holds"):
        sinks.edge_records(edges_of(spark, [pair])).collect()
    assert not (tmp_path / "g.dat").exists()


def test_sequences_and_trees_that_no_file_holds(spark, tmp_path):
    for bad in ([(0, 2**32 + 7), (1, 5)], [(0, None), (1, 5)], [(0, 1), (2, 5)], [(0, 1), (0, 5)]):
        with pytest.raises(Exception, match="a record holds|null|places must be"):
            sinks.write_binary_sequence(spark.createDataFrame(bad, "pos long, vid long"), f"{tmp_path}/s")
    with pytest.raises(Exception, match="a record holds"):
        sinks.write_tree(spark.createDataFrame([(0, None, 2**33)], "jnid long, parent long, pst_weight long"), f"{tmp_path}/t")
    assert not (tmp_path / "s").exists() and not (tmp_path / "t").exists()


def test_damaged_files(spark, tmp_path):
    (tmp_path / "g.dat").write_bytes(b"x" * 30)
    (tmp_path / "s").write_bytes(struct.pack("<QII", 3, 1, 2))
    with pytest.raises(Exception, match="whole records"):
        graphs.read_binary_edges(spark, f"{tmp_path}/g.dat").collect()
    with pytest.raises(Exception, match="its head says 3 records"):
        graphs.read_sequence(spark, f"{tmp_path}/s", binary=True).collect()
    (tmp_path / "e.dat").write_bytes(b"")
    assert graphs.read_edges(spark, f"{tmp_path}/e.dat").count() == 0


def test_shares_cover_every_byte_once():
    rng = random.Random(2)
    for _ in range(200):
        sizes, parts, step = [rng.randrange(60) for _ in range(rng.randint(0, 4))], rng.randint(1, 5), rng.randint(1, 20)
        got = [x for p in range(parts) for k, a, b in records.shares(sizes, p, parts, step, 1) for x in [(k, i) for i in range(a, b)]]
        assert got == [(k, i) for k, s in enumerate(sizes) for i in range(s)]


def test_shares_of_text_files(spark, tmp_path, monkeypatch):
    """Each line in one share, wherever the cuts fall; comments and odd lines are left out, as in a whole read."""
    rng = random.Random(3)
    lines = [f"{rng.randrange(10**rng.randint(1, 9))} {'  ' * rng.randint(0, 2)}{rng.randrange(1000)}" for _ in range(60)] + ["# 1 2", "", "x 1 2", "7", " 5\t6 7"]
    rng.shuffle(lines)
    (tmp_path / "g.net").write_text("\n".join(lines))
    want = rows(graphs.read_text_edges(spark, f"{tmp_path}/g.net"))
    assert len(want) == 61
    size = len("\n".join(lines))
    for parts in (1, 4):
        assert sorted(sum((rows(graphs.read_edges(spark, f"{tmp_path}/g.net", k, parts)) for k in range(parts)), [])) == want
    # every cut at all, on the reader itself
    monkeypatch.setattr(records, "CHUNK_BYTES", 50)
    reader = records.Reader({"kind": "text", "path": f"{tmp_path}/g.net"})
    for cut in range(1, size):
        got = [tuple(r.values()) for a, b in ((0, cut), (cut, size)) for batch in reader.read(records.Share(f"{tmp_path}/g.net", a, b)) for r in batch.to_pylist()]
        assert sorted(got) == want


def test_sequences_with_repeats(spark, tmp_path):
    edges = edges_of(spark, [(1, 2), (2, 3)])
    twice = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1)], "pos long, vid long")
    with pytest.raises(ValueError, match="vid 1 stands more than once"):
        partitioning.graph_to_tree(edges, twice)
    with pytest.raises(ValueError, match="pos 0 stands more than once"):
        sequence.checked(spark.createDataFrame([(0, 1), (0, 2)], "pos long, vid long"))
    (tmp_path / "seq").write_text("1\n2\n1\n")
    with pytest.raises(ValueError, match="more than once"):
        graphs.read_sequence(spark, f"{tmp_path}/seq")


def test_partition_files_of_another_length(spark, tmp_path):
    seq = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "pos long, vid long")
    for text in ("0\n1\n", "0\n1\n0\n1\n"):
        (tmp_path / "parts").write_text(text)
        with pytest.raises(ValueError, match="parts for 3 vertices"):
            graphs.read_partition(spark, f"{tmp_path}/parts", seq)


def test_trees_of_shares(spark, tmp_path):
    pairs = sorted({(a, b) for a, b in ((random.Random(k).randrange(30), random.Random(-k - 1).randrange(30)) for k in range(120)) if a != b})
    sinks.write_binary_edges(edges_of(spark, pairs), f"{tmp_path}/g.dat")
    seq = sequence.degree_sequence(edges_of(spark, pairs))
    parts = [partitioning.partial_tree(spark, f"{tmp_path}/g.dat", seq, k, 3) for k in range(3)]
    whole = tree.build_tree(tree.positioned(edges_of(spark, pairs), seq), seq)
    assert sorted(map(str, tree.merge_trees(tree.merge_trees(parts[0], parts[1]), parts[2]).collect())) == sorted(map(str, whole.collect()))
