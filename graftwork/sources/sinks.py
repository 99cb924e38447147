"""Writers, and the text and binary forms that they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges as rg
from ..operators.ends import with_ends
from ..operators.sequence import degrees
from ..operators.tree import kids, with_last
from ..storage import materialize
from .records import MOST, write_records


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("value"))


def write_text_edges(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.text(path)


def _little(x: Column) -> Column:
    """The four bytes of an id, lowest first."""
    id_ = F.when(x.between(0, MOST), x.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no record holds the id "), x.cast("string"))))
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(id_, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)))


def edge_records(edges: DataFrame) -> DataFrame:
    """Each edge as its record of 12 bytes, weight 1."""
    return edges.select(F.concat(_little(F.col("src")), _little(F.col("dst")), F.unhex(F.lit("0000803F"))).alias("record"))


def write_binary_edges(edges: DataFrame, path: str) -> None:
    """A folder of files of records of 12 bytes, weight 1 if there is no ``weight``, written by all tasks. Ids that aren't 0 to 2^32 - 2 are an error."""
    write_records(edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [])), path, "edges")


def write_partitioned(assigned: DataFrame, path: str) -> None:
    """A folder part=N for each part, with lines "src dst"."""
    assigned.select(F.concat_ws(" ", "src", "dst").alias("value"), "part").write.partitionBy("part").text(path)


def write_sequence(seq: DataFrame, path: str) -> None:
    """One id a line; part files are in the sequence's order."""
    seq.orderBy("pos").select(F.col("vid").cast("string").alias("value")).write.text(path)


def write_binary_sequence(seq: DataFrame, path: str) -> None:
    """A file: a 64-bit count and 32-bit ids. Ids that aren't 0 to 2^32 - 2 are an error."""
    write_records(seq.select(F.col("pos").alias("place"), "vid"), path, "sequence")


def write_partition(parts: DataFrame, seq: DataFrame, path: str) -> None:
    """One part a line, in the order of the sequence."""
    seq.join(parts, "vid").orderBy("pos").select(F.col("part").cast("string").alias("value")).write.text(path)


def write_tree(tree: DataFrame, path: str) -> None:
    """A tree file: the count, then parent, pst_weight and, if there is one, pre_weight of each node. Numbers beyond 2^32 - 2 are an error."""
    more = ["pre_weight"] if "pre_weight" in tree.columns else []
    write_records(tree.select(F.col("jnid").alias("place"), "parent", "pst_weight", *more), path, "weighted_tree" if more else "tree")


def graph_adjacency(edges: DataFrame, seq: DataFrame) -> DataFrame:
    """(line, value) of an adjacency file: "n m 010", then for each vertex its degree, loops included, and its neighbours' positions from 1."""
    e = with_ends(edges.select("src", "dst").where("src <> dst"), seq, 16).where("pos_x is not null and pos_y is not null").select((F.col("pos_x") + 1).alias("line"), (F.col("pos_y") + 1).alias("at"))
    both = e.select(F.explode(F.array(F.struct("line", "at"), F.struct(F.col("at").alias("line"), F.col("line").alias("at")))).alias("e")).select("e.*")
    near = both.groupBy("line").agg(F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x.cast("string")), " ").alias("near"))
    rows = seq.join(degrees(edges), "vid").select((F.col("pos") + 1).alias("line"), "degree").join(near, "line", "left")
    head = seq.agg(F.count("*").alias("n")).join(edges.where("src <> dst").agg(F.count("*").alias("m"))).select(F.lit(0).cast("long").alias("line"), F.concat_ws(" ", "n", "m", F.lit("010")).alias("value"))
    return head.unionByName(rows.select("line", F.concat_ws(" ", F.col("degree").cast("string"), "near").alias("value")))


def tree_edge_weights(tree: DataFrame) -> DataFrame:
    """jnid, parent, weight: of each vertex's edge to its parent, what cutting the tree there may cost: as many vertices as lie on either side, but on
    neither more than the edges that leave the vertex's subtree.

    Those edges are sums over the subtree: the edges of its vertices to later ones, less those that end within it, which are
    what children's subtrees send to their parents (pre_weight).
    """
    inner = tree.where("parent is not null").groupBy(F.col("parent").alias("p2")).agg(F.sum("pre_weight").alias("inner"))
    one = F.lit(1).cast("long")
    own = tree.join(inner, F.col("jnid") == F.col("p2"), "left").select("jnid", "parent", (F.col("pst_weight") - F.coalesce("inner", F.lit(0))).alias("leaving"), one.alias("size"))
    own = with_last(materialize(own, "leaving"), tree)
    below = rg.subtree_sums(own, ["leaving", "size"]).select("jnid", "leaving", "size")
    above = rg.way_sums(own, ["size"]).select(F.col("jnid").alias("a2"), F.col("size").alias("above"))
    rows = tree.where("parent is not null").select("jnid", "parent").join(below, "jnid").join(above, F.col("parent") == F.col("a2"))
    return rows.select("jnid", "parent", (F.least("size", "leaving") + F.least("above", "leaving")).alias("weight"))


def tree_adjacency(tree: DataFrame) -> DataFrame:
    """(line, value) of a tree's adjacency file: "n e 011", then 1 and each neighbour with the weight of the edge to it, the parent first, then
    children in order.

    The tree needs its pre_weight.
    """
    edges = materialize(tree_edge_weights(tree), "tree_edges")
    both = edges.select("jnid", F.lit(0).alias("kind"), F.col("parent").alias("near"), "weight").unionByName(edges.select(F.col("parent").alias("jnid"), F.lit(1).alias("kind"), F.col("jnid").alias("near"), "weight"))
    near = both.groupBy("jnid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "near", "weight"))), lambda x: F.concat_ws(" ", x["near"] + 1, x["weight"])), " ").alias("near"))
    lines = tree.select("jnid").join(near, "jnid", "left").select((F.col("jnid") + 1).alias("line"), F.concat_ws(" ", F.lit("1"), "near").alias("value"))
    head = tree.agg(F.count("*").alias("n"), F.count("parent").alias("e")).select(F.lit(0).cast("long").alias("line"), F.concat_ws(" ", "n", "e", F.lit("011")).alias("value"))
    return head.unionByName(lines)


def tree_dot(tree: DataFrame) -> DataFrame:
    """(line, value) of a tree in DOT: an arrow from each child to its parent, later children first."""
    n = tree.count()
    arrows = tree.where("parent is not null").select((F.lit(n) - F.col("jnid")).alias("line"), F.concat(F.lit("\t"), "jnid", F.lit(" -> "), "parent").alias("value"))
    ends = tree.sparkSession.createDataFrame([(0, "digraph {"), (n + 1, "}")], "line long, value string")
    return ends.unionByName(arrows)


def tree_rows(tree: DataFrame, seq: DataFrame) -> DataFrame:
    """What a printed tree shows: jnid, vid, width, pst_weight, parent and children."""
    t = tree.join(seq.withColumnRenamed("pos", "jnid"), "jnid").join(kids(tree), "jnid", "left")
    return t.select("jnid", "vid", (1 + F.col("pst_weight")).alias("width"), "pst_weight", "parent", F.coalesce("kids", F.array().cast("array<long>")).alias("kids"))


def part_counts(parts: DataFrame) -> DataFrame:
    """Vertices of each part."""
    return parts.groupBy("part").agg(F.count("*").alias("vertices"))
