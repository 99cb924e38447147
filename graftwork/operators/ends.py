"""Edges with what is known of their ends.

A small table of vertices is broadcast, if the bytes of its rows, counted first, allow it. Else edges are shuffled by their ends, but not those of
*hubs*: vertices with so many edges that one would fill a good part of a task. A graph of m edges has at most 2 * HUBS such vertices whatever its
size, as each has a HUBS-th of all edges at least; their rows go to all tasks, and their edges are spread evenly instead of meeting in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fits_broadcast, materialize

#: A vertex with more than one in so many edges is a hub.
HUBS = 1000


def hubs(edges: DataFrame) -> DataFrame:
    """vid of the vertices that have more than one in HUBS of all edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))
    total = edges.count()
    return materialize(ends.where(F.col("n") > max(1, total // HUBS)).select("vid"), "hubs")


def with_ends(edges: DataFrame, info: DataFrame, width: int) -> DataFrame:
    """All edges with the columns of info(vid, ...), null where it lacks a vertex: those of src as ``c_x``, those of dst as ``c_y``, vid_x and vid_y among them.

    ``width``: bytes of a row of ``info``. vid must stand once in ``info``; edges keep all their columns and may repeat.
    """
    of = lambda df, mark: df.select(*(F.col(c).alias(f"{c}_{mark}") for c in info.columns))
    if fits_broadcast(info, width):
        out = edges
        for end, mark in (("src", "x"), ("dst", "y")):
            out = out.join(F.broadcast(of(info, mark)), F.col(end) == F.col(f"vid_{mark}"), "left")
        return out
    info = materialize(info, "vertices")
    heavy = hubs(edges)
    few = materialize(info.join(F.broadcast(heavy.withColumnRenamed("vid", "hub")), F.col("vid") == F.col("hub"), "left_semi"), "hub_rows")
    marks = F.broadcast(heavy.withColumnRenamed("vid", "hub"))
    out = edges
    for end, mark in (("src", "x"), ("dst", "y")):
        names = [f"{c}_{mark}" for c in info.columns]
        near = out.join(marks, F.col(end) == F.col("hub"), "left").withColumn("is_hub", F.col("hub").isNotNull()).drop("hub")
        # an edge of a hub looks for a vertex that isn't there, another one each time, so that it is dealt out evenly
        spread = F.when(F.col("is_hub"), F.xxhash64("src", "dst", F.monotonically_increasing_id())).otherwise(F.col(end))
        rest = of(info, mark).withColumn("of_hub", F.lit(False))
        near = near.withColumn("looked", spread).join(rest, (F.col("looked") == F.col(f"vid_{mark}")) & (F.col("is_hub") == F.col("of_hub")), "left").drop("looked", "of_hub")
        again = of(few, mark).select(*(F.col(c).alias(f"hub_{c}") for c in names))
        near = near.join(F.broadcast(again), F.col(end) == F.col(f"hub_vid_{mark}"), "left")
        out = near.select(*out.columns, *(F.coalesce(f"hub_{c}", c).alias(c) for c in names))
    return out
