"""Figures of a tree in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import path_figures


def tree_facts(tree: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """vert_cnt, edge_cnt, width, fill, vert_height, edge_height, root_cnt, halo_id, core_id, core_as_is.

    ``widths`` (jnid, width) are those of the filled graph; without them a node's width is 1 + its weight and fill is 0. halo: the
    first node wider than 3; core: the first of the greatest width; core_as_is: what tools report that compare each width with the greatest one so far after
    raising it, which is the first node.
    """
    t = tree.select("jnid", "parent", "pst_weight")
    t = t.join(widths.select("jnid", "width"), "jnid", "left") if widths is not None else t.withColumn("width", 1 + F.col("pst_weight"))
    t = t.join(path_figures(tree).select("jnid", "depth", "path_weight"), "jnid")
    return t.agg(
        F.count("*").alias("vert_cnt"), F.coalesce(F.sum("pst_weight"), F.lit(0)).alias("edge_cnt"), F.max("width").cast("long").alias("width"),
        F.coalesce(F.sum(F.col("width") - F.col("pst_weight") - 1), F.lit(0)).cast("long").alias("fill"), (F.max("depth") + 1).alias("vert_height"), F.max("path_weight").alias("edge_height"),
        F.count(F.when(F.col("parent").isNull(), 1)).alias("root_cnt"), F.min(F.when(F.col("width") > 3, F.col("jnid"))).alias("halo_id"), F.min_by("jnid", F.struct(-F.col("width"), F.col("jnid"))).alias("core_id"), F.min("jnid").alias("core_as_is"),
    )
