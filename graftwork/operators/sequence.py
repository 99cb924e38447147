"""Vertex orders: (pos, vid)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def doubled(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a loop stands twice, so it adds 2 to its vertex's degree."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges without repeats, smaller end first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """vid, degree (with multiplicity) of every vertex that has an edge. Partial counts are summed before the shuffle."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vid")).groupBy("vid").agg(F.count("*").alias("degree"))


def summed_degrees(parts: list[DataFrame]) -> DataFrame:
    """Degrees of a graph that is loaded in parts: those of the parts, added up."""
    counts = [degrees(p) for p in parts]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("vid").agg(F.sum("degree").alias("degree"))


def graph_counts(edges: DataFrame) -> DataFrame:
    """nodes, edges (loops included), max_vid (largest id + 1)."""
    n = degrees(edges).agg(F.count("*").alias("nodes"), (F.coalesce(F.max("vid"), F.lit(-1)) + 1).alias("max_vid"))
    return n.join(edges.agg(F.count("*").alias("edges")))


def neighbours(edges: DataFrame) -> DataFrame:
    """vid and its sorted neighbours, with multiplicity."""
    return doubled(edges).groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """(pos, vid) in the order of columns: a range sort, and offsets from the partitions' counts; no single task sees all rows."""
    put = df.repartitionByRange(*order).sortWithinPartitions(*order).select("vid", F.monotonically_increasing_id().alias("id"))
    put = materialize(put, "ranked")  # ranges are sampled, so they are fixed before they are counted
    part = F.shiftrightunsigned("id", 33)
    counts = sorted(put.groupBy(part.alias("part")).count().collect())  # a row for each partition
    at, rows = 0, []
    for p, n in counts:
        rows.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "part long, at long")
    in_part = F.col("id") - F.shiftleft(F.col("part"), 33)
    out = put.withColumn("part", part).join(F.broadcast(offsets), "part").select((F.col("at") + in_part).alias("pos"), "vid")
    out._rows = at
    return out


def checked(seq: DataFrame) -> DataFrame:
    """A sequence that a user gives: each vertex and each position once, or an error; else edges would count several times."""
    for c in ("vid", "pos"):
        if (twice := seq.groupBy(c).count().where("count > 1").select(c).first()) is not None:
            raise ValueError(f"{c} {twice[0]} stands more than once in the sequence")
    return seq


def degree_sequence(edges: DataFrame) -> DataFrame:
    """By degree, then vertex id."""
    return ranked(degrees(edges), "degree", "vid")


def default_sequence(edges: DataFrame) -> DataFrame:
    """By vertex id."""
    return ranked(degrees(edges), "vid")
