"""Whole runs, as the command line tools of a graph partitioner offer them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate as ev
from ..operators import facts, partition, sequence, tree
from ..sources import graphs, sinks
from ..storage import materialize


@dataclass
class Run:
    """What one run made; each is a DataFrame, None if it wasn't asked for."""

    edges: DataFrame
    seq: DataFrame
    tree: DataFrame
    facts: DataFrame | None = None
    valid: DataFrame | None = None
    kids: DataFrame | None = None
    later: DataFrame | None = None
    filled: DataFrame | None = None
    parts: dict[int, DataFrame] = field(default_factory=dict)
    evaluation: dict[int, DataFrame] = field(default_factory=dict)


def graph_to_tree(
    edges: DataFrame, seq: DataFrame | None = None, widths: bool = False, with_facts: bool = False, check: bool = False, with_kids: bool = False, with_later: bool = False,
    width_limit: int | None = None, find_max_width: bool = False, rooted: bool = False,
) -> Run:
    """Sequence (by degree unless given), tree and what else is asked for: facts, checks, children, later neighbours, and with
    ``widths`` those in the filled graph. A limit of width, an early end at the greatest width and rooting make the tree with its
    widths in one task. A graph loaded in part needs a sequence of the whole: trees over different orders don't merge."""
    seq = sequence.checked(seq) if seq is not None else sequence.degree_sequence(edges)
    epos = materialize(tree.positioned(edges, seq), "epos")
    special = width_limit is not None or find_max_width or rooted
    t = materialize(tree.limited(edges, seq, width_limit, find_max_width, rooted) if special else tree.build_tree(epos, seq), "tree")
    run = Run(edges, seq, t)
    if widths:
        run.filled = t.select("jnid", "width") if special else materialize(tree.filled(t, epos), "filled")
    if with_facts:
        run.facts = facts.tree_facts(t, run.filled)
    if check:
        run.valid = tree.validate(t, epos)
        if widths and not special:
            run.valid = run.valid.join(tree.validate_filled(t, run.filled))
    if with_kids:
        run.kids = tree.kids(t)
    if with_later:
        run.later = tree.pst_lists(edges, seq)
    return run


def partition_tree(run: Run, ks: list[int], method: str = "forward", balance: float = partition.BALANCE, evaluated: bool = True, **weights) -> Run:
    """Parts for each of the counts asked for, and what they cost."""
    for k in ks:
        run.parts[k] = materialize(partition.tree_partition(run.tree, run.seq, k, method, balance, **weights), "parts")
        if evaluated:
            run.evaluation[k] = ev.evaluate(run.edges, run.parts[k], run.seq, k)
    return run


def partial_tree(spark: SparkSession, graph: str, seq: DataFrame, part: int, parts: int) -> DataFrame:
    """The tree of a share of a graph file's edges, under a sequence of the whole graph; ``tree.merge_trees`` joins such trees."""
    edges = graphs.read_edges(spark, graph, part, parts)
    return materialize(tree.build_tree(tree.positioned(edges, seq), seq), "tree")


def distributed_partition(spark: SparkSession, graph: str, ks: list[int], out: str | None = None, seq: str | None = None, method: str = "forward") -> Run:
    """From a graph file to parts and, with ``out``, partitioned edge files, a folder for each number of parts."""
    edges = graphs.read_edges(spark, graph)
    run = partition_tree(graph_to_tree(edges, graphs.read_sequence(spark, seq) if seq else None, with_facts=True), ks, method)
    if out:
        for k, parts in run.parts.items():
            sinks.write_partitioned(ev.assign_edges(edges, parts, run.seq), f"{out}/{k}")
    return run
