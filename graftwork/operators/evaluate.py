"""What a partition costs: edges cut, communication volume, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import golden_hash
from ..storage import materialize
from .ends import with_ends
from .sequence import ranked


def _joined(edges: DataFrame, parts: DataFrame, seq: DataFrame | None) -> DataFrame:
    """Each edge with the parts and positions of its ends; an edge that lacks a part at one end goes."""
    info = parts.select("vid", "part")
    if seq is not None:
        info = info.join(seq.select(F.col("vid").alias("v2"), "pos"), F.col("vid") == F.col("v2"), "left").drop("v2")
    info = materialize(info, "parts")  # counted, and read for both ends
    e = with_ends(edges.select("src", "dst"), info, 24).where("vid_x is not null and vid_y is not null")
    return e.withColumnsRenamed({"src": "x", "dst": "y"})


def _owners(e: DataFrame, seq: bool) -> dict[str, object]:
    """The part of an edge under each rule."""
    x_first = golden_hash(F.col("x")) < golden_hash(F.col("y"))
    y_first = golden_hash(F.col("y")) < golden_hash(F.col("x"))
    # each direction asks whether its own first end is strictly less; ends of one hash differ by direction
    rules = {"hash": (F.when(x_first, F.col("part_x")).otherwise(F.col("part_y")), F.when(y_first, F.col("part_y")).otherwise(F.col("part_x")))}
    if seq:
        low = F.when(F.col("pos_x") < F.col("pos_y"), F.col("part_x")).otherwise(F.col("part_y"))
        high = F.when(F.col("pos_x") < F.col("pos_y"), F.col("part_y")).otherwise(F.col("part_x"))
        rules |= {"down": (low, low), "up": (high, high)}
    return rules


def evaluate(edges: DataFrame, parts: DataFrame, seq: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """One row: nodes, edges, edges_cut, vcom_vol, vertex_bal, ecv_hash, hash_bal, with ``seq`` also ecv_down, down_bal, ecv_up,
    up_bal, with ``k`` also ratios (null where a denominator is 0). Loops count as edges only."""
    e = _joined(edges, parts, seq)
    rules = _owners(e, seq is not None)
    # one pass: each edge gives its two directions, with the part of the other end and the parts that own it
    sides = [
        F.struct(F.col("x").alias("v"), F.col("part_x").alias("own"), F.col("part_y").alias("other"), (F.col("x") < F.col("y")).alias("once"), *(r[0].alias(n) for n, r in rules.items())),
        F.struct(F.col("y").alias("v"), F.col("part_y").alias("own"), F.col("part_x").alias("other"), (F.col("y") < F.col("x")).alias("once"), *(r[1].alias(n) for n, r in rules.items())),
    ]
    d = e.select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    # one shuffle by vertex: the sets hold parts, so they are never larger than the number of parts
    sets = [F.size(F.collect_set(F.when(F.col("own") != F.col("other"), F.col("other")))).alias("vcom_vol"), *(F.size(F.collect_set(n)).alias(f"touched_{n}") for n in rules)]
    cut = F.count(F.when(F.col("once") & (F.col("own") != F.col("other")), 1)).alias("edges_cut")
    out = d.groupBy("v").agg(cut, *sets).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edges_cut", "vcom_vol", *(f"touched_{n}" for n in rules))))
    # one more by part, with a row for each rule and part
    loads = d.where("once").select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("part")) for n in rules))).alias("l")).select("l.*")
    loads = loads.unionByName(parts.select(F.lit("vertex").alias("rule"), "part")).groupBy("rule", "part").count()
    of = lambda n: F.when(F.col("rule") == n, F.col("count"))
    most = loads.agg(F.coalesce(F.sum(of("vertex")), F.lit(0)).alias("nodes"), *(F.coalesce(F.max(of(n)), F.lit(0)).alias(f"{n}_bal") for n in ("vertex", *rules)))
    out = out.join(most).join(edges.agg(F.count("*").alias("edges")))
    out = out.withColumns({f"ecv_{n}": F.col(f"touched_{n}") - F.col("nodes") for n in rules})
    names = ["nodes", "edges", "edges_cut", "vcom_vol", "vertex_bal", *(c for n in rules for c in (f"ecv_{n}", f"{n}_bal"))]
    if k is None:
        return out.select(*names)
    per_edge = [F.expr(f"try_divide({c}, edges)").alias(f"{c}_ratio") for c in ("edges_cut", "vcom_vol", *(f"ecv_{n}" for n in rules))]
    per_part = [F.expr(f"try_divide(vertex_bal, nodes div {k})").alias("vertex_bal_ratio"), *(F.expr(f"try_divide({n}_bal, edges div {k})").alias(f"{n}_bal_ratio") for n in rules)]
    return out.select(*names, *per_edge, *per_part)


def assign_edges(edges: DataFrame, parts: DataFrame, seq: DataFrame, canonical: bool = True) -> DataFrame:
    """src, dst, part: each edge belongs to the part of its earlier end. ``canonical``: smaller id first, loops go; else as in the
    input, and a loop belongs to its own vertex's part."""
    e = _joined(edges, parts, seq).select("x", "y", F.when(F.col("pos_x") < F.col("pos_y"), F.col("part_x")).otherwise(F.col("part_y")).alias("part"))
    if canonical:
        e = e.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "part")
    return e.select(F.col("x").alias("src"), F.col("y").alias("dst"), "part")


def isomorphic(edges: DataFrame, parts: DataFrame, seq: DataFrame, canonical: bool = True) -> DataFrame:
    """Edges between new vertex numbers, which are those of the sequence sorted by part; src < dst if ``canonical``, loops go."""
    new = ranked(seq.join(parts, "vid").select("vid", "part", "pos"), "part", "pos")
    e = with_ends(edges.select("src", "dst"), new, 16).where("pos_x is not null and pos_y is not null").select(F.col("pos_x").alias("src"), F.col("pos_y").alias("dst"))
    return e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if canonical else e
