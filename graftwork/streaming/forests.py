"""An extension: a tree kept up to date as edges stream in, under a fixed sequence.

By the merge law a batch's forest joins the stored one, so state never exceeds a row for each vertex. State is written as
versioned tables by batch number, so a batch that is run again writes the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.tree import build_tree, merge_trees, positioned


def merge_batch(state: str, seq: DataFrame) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: joins a batch of edges(src, dst) to the tree of the batch before."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tree = build_tree(positioned(batch, seq), seq)
        if number > 0:
            tree = merge_trees(spark.read.parquet(f"{state}/version={number - 1}"), tree)
        tree.write.mode("overwrite").parquet(f"{state}/version={number}")

    return run


def keep_tree(edges: DataFrame, seq: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that keeps the tree of all edges so far at ``state``."""
    return edges.writeStream.foreachBatch(merge_batch(state, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
