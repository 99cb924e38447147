"""Edges meet what is known of their ends, hubs or not, and trees that are closed early."""

import random

import pytest
from pyspark.sql import functions as F

from graftwork import storage
from graftwork.functions import kernels
from graftwork.operators import ends, sequence, tree
from graftwork.operators import ranges as rg

from .test_graphs import edges_of, random_graph, rows


@pytest.mark.parametrize("room", [0, 1 << 20])
def test_with_ends(spark, monkeypatch, room):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", room)
    monkeypatch.setattr(ends, "HUBS", 5)
    pairs = [(0, k % 40) for k in range(300)] + random_graph(random.Random(1), 50, 100) + [(7, 7), (99, 1), (1, 99), (98, 97)]
    info = spark.createDataFrame([(v, v * 10, f"n{v}") for v in range(0, 45)], "vid long, a long, is_hub string")
    known = {v: (v, v * 10, f"n{v}") for v in range(0, 45)}
    none = (None,) * 3
    want = sorted(((x, y, "e", *known.get(x, none), *known.get(y, none)) for x, y in pairs), key=str)
    got = ends.with_ends(edges_of(spark, pairs).withColumn("tag", F.lit("e")), info, 24)
    assert got.columns == ["src", "dst", "tag", "vid_x", "a_x", "is_hub_x", "vid_y", "a_y", "is_hub_y"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_edges_of_a_hub_are_spread(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = spark.range(100_000).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"))
        seq = spark.range(100_001).select(F.col("id").alias("vid"), F.col("id").alias("pos"))
        out = ends.with_ends(star, seq, 16)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 100_000 and len(sizes) == 16 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
        assert out.where("pos_x <> 0 or pos_y <> dst or pos_x is null or pos_y is null").count() == 0
    finally:
        for k, v in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "3"), ("spark.sql.autoBroadcastJoinThreshold", "10485760")):
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [6, 1000])
def test_closed_trees(spark, monkeypatch, size):
    """As inserting one vertex after the other gives them, also under a sequence that omits vertices."""
    monkeypatch.setattr(rg, "RANGE_ROWS", size)
    rng = random.Random(4)
    pairs = random_graph(rng, 16, 30)
    edges = edges_of(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        if a != b:
            near.setdefault(b, []).append(a)
    for seq in (sequence.degree_sequence(edges), sequence.ranked(sequence.degrees(edges).where("vid % 5 <> 2"), "degree", "vid")):
        order = [v for _, v in rows(seq)]
        for rooted in (False, True):
            want = kernels.limited_tree(near, order, None, not rooted, rooted)
            got = tree.limited(edges, seq, find_max_width=not rooted, rooted=rooted)
            assert [r.asDict() for r in got.orderBy("jnid").collect()] == want
