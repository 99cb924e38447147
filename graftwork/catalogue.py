"""The registered queries of the graph operators, on the whole supplier-part graph, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashes
from .operators import evaluate as ev
from .operators import facts, partition, sequence, tree
from .plans import partitioning
from .sources import graphs, sinks
from .storage import materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Graph:
    """The graph of a data directory and what is derived from it, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.edges = materialize(graphs.supplier_part(spark, sf_dir), "edges")

    @property
    def seq(self) -> DataFrame:
        if not hasattr(self, "_seq"):
            self._seq = sequence.degree_sequence(self.edges)
        return self._seq

    @property
    def epos(self) -> DataFrame:
        if not hasattr(self, "_epos"):
            self._epos = materialize(tree.positioned(self.edges, self.seq), "epos")
        return self._epos

    @property
    def tree(self) -> DataFrame:
        if not hasattr(self, "_tree"):
            self._tree = materialize(tree.build_tree(self.epos, self.seq), "tree")
        return self._tree

    def built(self) -> DataFrame:
        """The tree, not stored: for queries that read it once."""
        return tree.build_tree(tree.positioned(self.edges, self.seq), self.seq)

    @property
    def folder(self) -> str:
        """A place for the files of a round trip."""
        return f"{shared_folder(self.edges.sparkSession)}/graftwork/files-{uuid.uuid4().hex}"

    def hash_parts(self, k: int = 4) -> DataFrame:
        return partition.hash_partition(self.edges, k)


# SQL of the same things; each text is a list of common table expressions
_E = "e AS (SELECT DISTINCT l_suppkey::BIGINT AS src, (1000000 + l_partkey)::BIGINT AS dst FROM lineitem)"
_D = _E + ", d AS (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT x AS vid, count(*) AS degree FROM d GROUP BY x)"
_S = _D + ", seq AS (SELECT row_number() OVER (ORDER BY degree, vid) - 1 AS pos, vid FROM deg)"


def _positions(seq: str) -> str:
    return f", epos AS (SELECT least(a.pos, b.pos) AS lo, greatest(a.pos, b.pos) AS hi FROM e JOIN {seq} a ON a.vid = e.src JOIN {seq} b ON b.vid = e.dst WHERE e.src <> e.dst)"


def _tree_of(seq: str) -> str:
    """Edges are rewritten until each vertex has one later neighbour: lo's neighbours become a chain."""
    return f""", rw AS (
  SELECT 0 AS r, lo, hi FROM (SELECT DISTINCT lo, hi FROM epos)
  UNION ALL
  SELECT r + 1, lo2, hi FROM (SELECT DISTINCT r, coalesce(lag(hi) OVER (PARTITION BY lo ORDER BY hi), lo) AS lo2, hi FROM rw)
  WHERE (SELECT max(c) FROM (SELECT count(*) AS c FROM rw GROUP BY lo)) > 1),
up AS (SELECT lo AS child, hi AS parent FROM rw WHERE r = (SELECT max(r) FROM rw)),
pst AS (SELECT lo, count(*) AS n FROM epos GROUP BY lo),
tree AS (SELECT s.pos AS jnid, up.parent, coalesce(pst.n, 0)::BIGINT AS pst_weight FROM {seq} s LEFT JOIN up ON up.child = s.pos LEFT JOIN pst ON pst.lo = s.pos)"""


_P = _S + _positions("seq")
_T = _P + _tree_of("seq")
_ABOVE = _T + ", above AS (SELECT jnid AS v, jnid AS a, 0 AS steps FROM tree UNION ALL SELECT v, t.parent, steps + 1 FROM above JOIN tree t ON t.jnid = above.a WHERE t.parent IS NOT NULL)"
_HASH = "((({}::HUGEINT) * 2654435769) % 4294967296)::BIGINT"
_PARTS = _P + f", parts AS (SELECT vid, ({_HASH.format('vid')} % 4)::INTEGER AS part FROM deg)"
_ENDS = _PARTS + f""", n AS (SELECT p.vid, p.part, s.pos, {_HASH.format('p.vid')} AS h FROM parts p JOIN seq s USING (vid)),
j AS (SELECT x, y, a.part AS px, b.part AS py, CASE WHEN a.h < b.h THEN a.part ELSE b.part END AS hash_part,
  CASE WHEN a.pos < b.pos THEN a.part ELSE b.part END AS down_part, CASE WHEN a.pos < b.pos THEN b.part ELSE a.part END AS up_part
  FROM d JOIN n a ON a.vid = d.x JOIN n b ON b.vid = d.y)"""


def _query(name: str, sql: str | None = None):
    def put(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = "WITH RECURSIVE " + sql
        return f

    return put


_query("gp_edges_distinct", _E + " SELECT src, dst FROM e")(lambda g: g.edges)
_query("gp_edges_doubled", _D + " SELECT x AS src, y AS dst FROM d")(lambda g: sequence.doubled(g.edges))
_query("gp_nodes_degree", _D + " SELECT vid, degree FROM deg")(lambda g: sequence.degrees(g.edges))
_query("gp_graph_counts", _D + " SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT max(vid) + 1 FROM deg) AS max_vid, (SELECT count(*) FROM e) AS edges")(lambda g: sequence.graph_counts(g.edges))
_query("gp_neighbours", _D + " SELECT x AS vid, count(*) AS n, sum(y)::BIGINT AS total, min(y) AS first, max(y) AS last FROM d GROUP BY x")(
    lambda g: sequence.neighbours(g.edges).select("vid", F.size("nbrs").cast("long").alias("n"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("nbrs", 1).alias("first"), F.element_at("nbrs", -1).alias("last"))
)
_query("gp_default_sequence", _D + " SELECT row_number() OVER (ORDER BY vid) - 1 AS pos, vid FROM deg")(lambda g: sequence.default_sequence(g.edges))
_query("gp_degree_sequence", _S + " SELECT pos, vid FROM seq")(lambda g: g.seq)


@_query("gp_partial_degree_sum", _D + " SELECT vid, degree::BIGINT AS degree FROM deg")
def _partial(g: Graph) -> DataFrame:
    share = F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    return sequence.summed_degrees([g.edges.where(share == i) for i in range(3)])


_query("gp_edges_positioned", _P + " SELECT lo, hi FROM epos")(lambda g: g.epos)
_query("gp_pst_weight", _P + " SELECT lo AS jnid, count(*) AS pst_weight FROM epos GROUP BY lo")(lambda g: tree.pst_weight(g.epos))
_query("gp_pst_lists", _P + " SELECT lo AS jnid, string_agg(vid::VARCHAR, ' ' ORDER BY vid) AS pst FROM (SELECT DISTINCT lo, vid FROM epos JOIN seq ON seq.pos = epos.hi) GROUP BY lo")(
    lambda g: tree.pst_lists(g.edges, g.seq).select("jnid", F.array_join(F.transform("pst", lambda x: x.cast("string")), " ").alias("pst"))
)
_query("gp_tree", _T + " SELECT jnid, parent, pst_weight FROM tree")(lambda g: g.built())


@_query("gp_tree_merged", _T + " SELECT jnid, parent, pst_weight FROM tree")
def _merged(g: Graph) -> DataFrame:
    part = F.pmod(F.xxhash64("lo", "hi"), F.lit(2))
    return tree.merge_trees(*(tree.build_tree(g.epos.where(part == i), g.seq) for i in range(2)))


_USER = _D + ", seq AS (SELECT row_number() OVER (ORDER BY vid DESC) - 1 AS pos, vid FROM deg)" + _positions("seq") + _tree_of("seq")


@_query("gp_user_sequence_tree", _USER + " SELECT jnid, parent, pst_weight FROM tree")
def _user(g: Graph) -> DataFrame:
    """A sequence of the user's own: ids from the last to the first."""
    seq = sequence.ranked(sequence.degrees(g.edges).select("vid", (-F.col("vid")).alias("k")), "k")
    return tree.build_tree(tree.positioned(g.edges, seq), seq)


_query("gp_kids", _T + " SELECT parent AS jnid, count(*) AS n, string_agg(jnid::VARCHAR, ' ' ORDER BY jnid) AS kids FROM tree WHERE parent IS NOT NULL GROUP BY parent")(
    lambda g: tree.kids(g.tree).select("jnid", F.size("kids").cast("long").alias("n"), F.array_join(F.transform("kids", lambda x: x.cast("string")), " ").alias("kids"))
)
_query("gp_tree_prefix", _T + " SELECT jnid, CASE WHEN parent < 100 THEN parent END AS parent, pst_weight FROM tree WHERE jnid < 100")(lambda g: tree.prefix(g.tree, 100))
_query("gp_pre_weight", _ABOVE + " SELECT t.jnid, count(epos.lo)::BIGINT AS pre_weight FROM tree t LEFT JOIN above ON above.a = t.jnid LEFT JOIN epos ON epos.lo = above.v AND epos.hi = t.parent GROUP BY t.jnid")(lambda g: tree.pre_weights(g.tree, g.epos))
_JXN = _ABOVE + ", jx AS (SELECT DISTINCT above.a AS jnid, epos.hi AS u FROM above JOIN epos ON epos.lo = above.v WHERE epos.hi > above.a)"
_query("gp_jxn", _JXN + " SELECT t.jnid, (1 + count(jx.u))::BIGINT AS width, coalesce(sum(jx.u), 0)::BIGINT AS total FROM tree t LEFT JOIN jx ON jx.jnid = t.jnid GROUP BY t.jnid")(
    lambda g: tree.filled_sums(g.tree, g.epos)
)
_query("gp_fill", _JXN + " SELECT (count(*) - (SELECT count(*) FROM epos))::BIGINT AS fill FROM jx")(lambda g: facts.tree_facts(g.tree, tree.widths(g.tree, g.epos)).select("fill"))
_query("gp_widths", _JXN + " SELECT t.jnid, (1 + count(jx.u))::BIGINT AS width FROM tree t LEFT JOIN jx ON jx.jnid = t.jnid GROUP BY t.jnid")(lambda g: tree.widths(g.tree, g.epos))


@_query("gp_jxn_validate_damaged", _JXN + """ SELECT count(*) FILTER (WHERE t.parent IS NOT NULL AND t.jnid % 9 = 4) AS bad_first,
 (SELECT count(DISTINCT jx.jnid) FROM jx JOIN tree s ON s.jnid = jx.jnid JOIN tree p ON p.jnid = s.parent WHERE p.jnid % 9 = 4 AND jx.u = p.parent)::BIGINT AS bad_subset FROM tree t""")
def _jxn_damaged(g: Graph) -> DataFrame:
    """What the validator says of a filled graph in which some vertices lack their first later neighbour."""
    whole = tree.filled(g.tree, g.epos)
    broken = whole.withColumn("jxn", F.when(F.col("jnid") % 9 == 4, F.slice("jxn", 2, 1 << 30)).otherwise(F.col("jxn")))
    return tree.validate_filled(g.tree, broken)


_HEIGHTS = _ABOVE + ", dep AS (SELECT v, max(steps) AS depth, sum(t.pst_weight) AS w FROM above JOIN tree t ON t.jnid = above.a GROUP BY v)"
_query("gp_heights", _HEIGHTS + " SELECT v AS jnid, depth::BIGINT AS depth, w::BIGINT AS path_weight, (SELECT max(steps) FROM above b WHERE b.a = dep.v)::BIGINT AS height, (SELECT count(*) FROM above b WHERE b.a = dep.v)::BIGINT AS subtree_size FROM dep")(
    lambda g: tree.path_figures(g.tree).drop("subtree_weight", "enter")
)
_query(
    "gp_tree_facts",
    _HEIGHTS
    + """ SELECT count(*) AS vert_cnt, sum(pst_weight)::BIGINT AS edge_cnt, (max(pst_weight) + 1)::BIGINT AS width, 0::BIGINT AS fill, (max(depth) + 1)::BIGINT AS vert_height, max(w)::BIGINT AS edge_height,
 count(*) FILTER (WHERE parent IS NULL) AS root_cnt, min(jnid) FILTER (WHERE pst_weight > 2) AS halo_id, min(jnid) FILTER (WHERE pst_weight = (SELECT max(pst_weight) FROM tree)) AS core_id, min(jnid) AS core_as_is FROM tree JOIN dep ON dep.v = tree.jnid""",
)(lambda g: facts.tree_facts(g.tree))
_query("gp_tree_validate", _T + " SELECT count(*) FILTER (WHERE parent <= jnid) AS bad_parents, count(*) FILTER (WHERE parent >= (SELECT count(*) FROM seq)) AS bad_edges, (sum(pst_weight) - (SELECT count(*) FROM epos))::BIGINT AS weight_gap FROM tree")(
    lambda g: tree.validate(g.tree, g.epos)
)


@_query(
    "gp_tree_validate_damaged",
    _T + """ SELECT count(*) FILTER (WHERE parent IS NOT NULL AND jnid % 11 = 3) AS bad_parents, count(*) FILTER (WHERE parent IS NOT NULL AND (jnid % 7 = 0 OR jnid % 11 = 3)) AS bad_edges,
 count(*) FILTER (WHERE jnid % 5 = 0) AS weight_gap FROM tree""",
)
def _damaged(g: Graph) -> DataFrame:
    """What the validator says of a tree in which some vertices lost their parents, some are their own, and some weigh too much."""
    id_ = F.col("jnid")
    broken = g.tree.select("jnid", F.when((id_ % 11 == 3) & F.col("parent").isNotNull(), id_).when(id_ % 7 != 0, F.col("parent")).alias("parent"), (F.col("pst_weight") + F.when(id_ % 5 == 0, 1).otherwise(0)).alias("pst_weight"))
    return tree.validate(broken, g.epos)


_query("gp_tree_width_limit")(lambda g: tree.limited(g.edges, g.seq, width_limit=30))
_query(
    "gp_tree_max_width",
    _JXN + """, ws AS (SELECT t.jnid, t.parent, t.pst_weight, 1 + count(jx.u) AS width FROM tree t LEFT JOIN jx ON jx.jnid = t.jnid GROUP BY ALL),
m AS (SELECT *, max(width) OVER (ORDER BY jnid) AS most FROM ws), z AS (SELECT min(jnid) AS last FROM m WHERE most >= (SELECT count(*) FROM seq) - jnid)
SELECT m.jnid, seq.vid, CASE WHEN parent <= z.last THEN parent END AS parent, pst_weight, width::BIGINT AS width FROM m JOIN seq ON seq.pos = m.jnid, z WHERE m.jnid <= z.last""",
)(lambda g: tree.limited(g.edges, g.seq, find_max_width=True))
_query(
    "gp_tree_rooted",
    _JXN + """, ws AS (SELECT t.jnid, t.parent, t.pst_weight, (1 + count(jx.u))::BIGINT AS width FROM tree t LEFT JOIN jx ON jx.jnid = t.jnid GROUP BY ALL), n AS (SELECT count(*) AS n FROM seq),
z AS (SELECT min(jnid) AS z FROM ws, n WHERE width = n - jnid)
SELECT ws.jnid, seq.vid, CASE WHEN ws.jnid > z THEN CASE WHEN ws.jnid + 1 < n THEN ws.jnid + 1 END WHEN parent <= z THEN parent WHEN z + 1 < n THEN z + 1 END AS parent, pst_weight,
 CASE WHEN ws.jnid > z THEN n - ws.jnid ELSE width END AS width FROM ws JOIN seq ON seq.pos = ws.jnid, n, z""",
)(lambda g: tree.limited(g.edges, g.seq, rooted=True))

_query("gp_hash_parts", _PARTS + " SELECT vid, part FROM parts")(lambda g: g.hash_parts())
_query("gp_part_counts", _PARTS + " SELECT part, count(*) AS vertices FROM parts GROUP BY part")(lambda g: sinks.part_counts(g.hash_parts()))
_EVAL = {
    "edges_cut": "(SELECT count(*) FROM j WHERE x < y AND px <> py)",
    "vcom_vol": "(SELECT count(*) FROM (SELECT DISTINCT x, py FROM j WHERE px <> py))",
    "vertex_bal": "(SELECT max(c) FROM (SELECT count(*) AS c FROM parts GROUP BY part))",
}
for _rule in ("hash", "down", "up"):
    _EVAL[f"ecv_{_rule}"] = f"((SELECT count(*) FROM (SELECT DISTINCT x, {_rule}_part FROM j)) - (SELECT count(*) FROM deg))"
    _EVAL[f"{_rule}_bal"] = f"(SELECT max(c) FROM (SELECT count(*) AS c FROM j WHERE x < y GROUP BY {_rule}_part))"
for _name, _sql in _EVAL.items():
    _query(f"gp_eval_{_name}", f"{_ENDS} SELECT {_sql}::BIGINT AS {_name}")(lambda g, c=_name: ev.evaluate(g.edges, g.hash_parts(), g.seq).select(c))
_RATIOS = ", ".join(f"({_EVAL[c]} / (SELECT count(*) FROM e)::DOUBLE) AS {c}_ratio" for c in ("edges_cut", "vcom_vol", "ecv_hash", "ecv_down", "ecv_up"))
_BALANCES = ", ".join(f"({_EVAL[c]} / ((SELECT count(*) FROM {t}) // 4)::DOUBLE) AS {c}_ratio" for c, t in (("vertex_bal", "deg"), ("hash_bal", "e"), ("down_bal", "e"), ("up_bal", "e")))
_query("gp_eval_all", f"{_ENDS} SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM e) AS edges, " + ", ".join(f"{s}::BIGINT AS {c}" for c, s in _EVAL.items()) + f", {_RATIOS}, {_BALANCES}")(
    lambda g: ev.evaluate(g.edges, g.hash_parts(), g.seq, 4)
)
_query("gp_edge_assign_down", _ENDS + " SELECT least(x, y) AS src, greatest(x, y) AS dst, down_part AS part FROM j WHERE x < y")(lambda g: ev.assign_edges(g.edges, g.hash_parts(), g.seq))
_query("gp_isomorphic", _ENDS + ", iso AS (SELECT vid, row_number() OVER (ORDER BY part, pos) - 1 AS p FROM n) SELECT least(a.p, b.p) AS src, greatest(a.p, b.p) AS dst FROM e JOIN iso a ON a.vid = e.src JOIN iso b ON b.vid = e.dst")(
    lambda g: ev.isomorphic(g.edges, g.hash_parts(), g.seq)
)
for _k in (2, 4, 8):
    _query(f"gp_forward_k{_k}")(lambda g, k=_k: partition.tree_partition(g.tree, g.seq, k))
def _filled(order: str) -> str:
    """Vertices in an order fill part after part."""
    return f""", c AS (SELECT floor(((SELECT sum(pst_weight) FROM tree)::BIGINT // 4) * 1.03)::BIGINT AS cap),
o AS (SELECT jnid, pst_weight, row_number() OVER (ORDER BY {order}, jnid) - 1 AS at FROM fig),
f AS (SELECT 0::BIGINT AS id, 0 AS part, 0::BIGINT AS size
  UNION ALL SELECT f.id + 1, CASE WHEN f.size + o.pst_weight >= c.cap THEN f.part + 1 ELSE f.part END, CASE WHEN f.size + o.pst_weight >= c.cap THEN 0 ELSE f.size + o.pst_weight END
  FROM f JOIN o ON o.at = f.id, c)
SELECT seq.vid, f.part FROM f JOIN o ON o.at = f.id JOIN seq ON seq.pos = o.jnid"""


_FIGURES = _ABOVE + """, hgt AS (SELECT a AS jnid, max(steps) AS height FROM above GROUP BY a), dpt AS (SELECT v AS jnid, max(steps) AS depth FROM above GROUP BY v),
sub AS (SELECT a AS jnid, sum(t.pst_weight)::BIGINT AS below, count(*) AS size FROM above JOIN tree t ON t.jnid = above.v GROUP BY a),
fig AS (SELECT * FROM tree JOIN hgt USING (jnid) JOIN dpt USING (jnid) JOIN sub USING (jnid))"""
_BACKWARD = _FIGURES + """, c AS (SELECT floor(((SELECT sum(pst_weight) FROM tree)::BIGINT // 4) * 1.03)::BIGINT AS cap),
best AS (SELECT parent, arg_min(jnid, {'w': -below, 'id': jnid}) AS kid FROM fig WHERE parent IS NOT NULL GROUP BY parent),
way AS (SELECT 0 AS n, (SELECT arg_min(jnid, {'w': -below, 'id': jnid}) FROM fig) AS v UNION ALL SELECT n + 1, best.kid FROM way JOIN best ON best.parent = way.v),
own AS (SELECT row_number() OVER (ORDER BY way.n DESC) - 1 AS k, way.v, fig.below - coalesce(lead(fig.below) OVER (ORDER BY way.n), 0) AS w FROM way JOIN fig ON fig.jnid = way.v),
f AS (SELECT -1::BIGINT AS k, 0 AS part, 0::BIGINT AS size
  UNION ALL SELECT f.k + 1, CASE WHEN f.size + own.w < c.cap THEN f.part ELSE f.part + 1 END, (CASE WHEN f.size + own.w < c.cap THEN f.size + own.w ELSE own.w END)::BIGINT FROM f JOIN own ON own.k = f.k + 1, c),
cut AS (SELECT own.v, f.part FROM f JOIN own USING (k)),
near AS (SELECT above.v, arg_min(cut.part, above.steps) AS part FROM above JOIN cut ON cut.v = above.a GROUP BY above.v)
SELECT seq.vid, coalesce(near.part, (SELECT max(part) FROM f)) AS part FROM seq LEFT JOIN near ON near.v = seq.pos"""
for _m, _sql in (("backward", _BACKWARD), ("depth", _FIGURES + _filled("depth DESC")), ("height", _FIGURES + _filled("height"))):
    _query(f"gp_{_m}", _sql)(lambda g, m=_m: partition.tree_partition(g.tree, g.seq, 4, m))
_query(
    "gp_naive",
    _T
    + """, c AS (SELECT floor(((SELECT sum(pst_weight) FROM tree)::BIGINT // 4) * 1.03)::BIGINT AS cap),
f AS (SELECT 0::BIGINT AS id, 0 AS part, 0::BIGINT AS size
  UNION ALL SELECT f.id + 1, CASE WHEN f.size + t.pst_weight >= c.cap THEN f.part + 1 ELSE f.part END, CASE WHEN f.size + t.pst_weight >= c.cap THEN 0 ELSE f.size + t.pst_weight END
  FROM f JOIN tree t ON t.jnid = f.id, c)
SELECT seq.vid, f.part FROM f JOIN seq ON seq.pos = f.id""",
)(lambda g: partition.tree_partition(g.tree, g.seq, 4, "naive"))
_query("gp_forward_eval_k4")(lambda g: ev.evaluate(g.edges, materialize(partition.tree_partition(g.tree, g.seq, 4), "parts"), g.seq, 4))


def _streamed(weight: str, total: str, scale: str) -> str:
    """One pass over vertices by id, with a list of their parts so far and the sizes of the parts."""
    value = "len(list_filter(nb.u, lambda x: f.placed[x] = p - 1)) - (c.a * pow(f.size[p] + w, 1.5) - c.a * pow(f.size[p], 1.5))"
    return _D + f""", vs AS (SELECT vid, row_number() OVER (ORDER BY vid) AS i FROM deg),
nb AS (SELECT a.i, list(b.i) AS u, {weight}::BIGINT AS w FROM d JOIN vs a ON a.vid = d.x JOIN vs b ON b.vid = d.y GROUP BY a.i),
n AS (SELECT (SELECT count(*) FROM deg) AS n, 2 * (SELECT count(*) FROM e) AS m),
c AS (SELECT floor(({total} // 4) * 1.03)::BIGINT AS cap, {scale} AS a FROM n),
f AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS placed, [0, 0, 0, 0]::BIGINT[] AS size
  UNION ALL SELECT i + 1, list_append(placed, best), list_transform(range(1, 5), lambda p: size[p] + CASE WHEN p - 1 = best THEN w ELSE 0 END)
  FROM (SELECT f.i, f.placed, f.size, nb.w, coalesce(list_max(list_transform(list_filter(range(1, CASE WHEN list_contains(f.size, 0) THEN list_position(f.size, 0) + 1 ELSE 5 END), lambda p: f.size[p] + w <= c.cap),
    lambda p: {{'v': {value}, 'p': 1 - p}})).p * -1, 0)::INTEGER AS best FROM f JOIN nb ON nb.i = f.i + 1, c)),
z AS (SELECT unnest(placed) AS part, unnest(range(1, len(placed) + 1)) AS i FROM f WHERE i = (SELECT n FROM n))
SELECT vs.vid, z.part FROM z JOIN vs USING (i)"""


_query("gp_vfennel_k4", _streamed("count(*)", "m", "n * pow(4 / m, 1.5)"))(lambda g: partition.stream_vertices(g.edges, 4))
_query("gp_vfennel_nodes_k4", _streamed("1", "n", "m * pow(4, 0.5) / pow(n, 1.5)"))(lambda g: partition.stream_vertices(g.edges, 4, by_edges=False))
_query("gp_efennel_k4")(lambda g: partition.stream_edges(g.edges, 4))
_query("gp_round_robin", _E + " SELECT src, dst, ((row_number() OVER (ORDER BY src, dst) - 1) % 4)::INTEGER AS part FROM e")(lambda g: partition.round_robin(g.edges, 4))
_query(
    "gp_metis_adj",
    _P
    + """, a AS (SELECT s.pos + 1 AS line, t.pos + 1 AS u FROM d JOIN seq s ON s.vid = d.x JOIN seq t ON t.vid = d.y WHERE d.x <> d.y)
SELECT 0::BIGINT AS line, concat((SELECT count(*) FROM seq), ' ', (SELECT count(*) FROM e WHERE src <> dst), ' 010') AS value
UNION ALL SELECT s.pos + 1, concat(deg.degree, ' ', (SELECT string_agg(u::VARCHAR, ' ' ORDER BY u) FROM a WHERE a.line = s.pos + 1)) FROM seq s JOIN deg USING (vid)""",
)(lambda g: sinks.graph_adjacency(g.edges, g.seq))
_query(
    "gp_tree_metis_adj",
    _FIGURES
    + """, pre AS (SELECT t.jnid, count(epos.lo) AS pre FROM tree t LEFT JOIN above ON above.a = t.jnid LEFT JOIN epos ON epos.lo = above.v AND epos.hi = t.parent GROUP BY t.jnid),
ew AS (SELECT a AS jnid, sum(t.pst_weight - CASE WHEN above.steps > 0 THEN pre.pre ELSE 0 END) AS w FROM above JOIN tree t ON t.jnid = above.v JOIN pre ON pre.jnid = above.v GROUP BY a),
x AS (SELECT fig.jnid, fig.parent, (least(fig.size, ew.w) + least(up.depth + 1, ew.w))::BIGINT AS w FROM fig JOIN ew USING (jnid) JOIN fig up ON up.jnid = fig.parent),
both_ AS (SELECT jnid, 0 AS kind, parent AS near, w FROM x UNION ALL SELECT parent, 1, jnid, w FROM x),
line AS (SELECT jnid, string_agg((near + 1)::VARCHAR || ' ' || w::VARCHAR, ' ' ORDER BY kind, near) AS near FROM both_ GROUP BY jnid)
SELECT 0::BIGINT AS line, concat((SELECT count(*) FROM tree), ' ', (SELECT count(*) FROM x), ' 011') AS value UNION ALL SELECT t.jnid + 1, concat_ws(' ', '1', line.near) FROM tree t LEFT JOIN line USING (jnid)""",
)(lambda g: sinks.tree_adjacency(g.tree.join(tree.pre_weights(g.tree, g.epos), "jnid")))
_query(
    "gp_tree_dot",
    _T + """ SELECT 0::BIGINT AS line, 'digraph {' AS value UNION ALL SELECT (SELECT count(*) FROM tree) + 1, '}'
UNION ALL SELECT (SELECT count(*) FROM tree) - jnid, concat(chr(9), jnid, ' -> ', parent) FROM tree WHERE parent IS NOT NULL""",
)(lambda g: sinks.tree_dot(g.tree))
_query("gp_tree_print", _T + " SELECT t.jnid, s.vid, 1 + t.pst_weight AS width, t.pst_weight, t.parent, (SELECT count(*) FROM tree k WHERE k.parent = t.jnid) AS n_kids FROM tree t JOIN seq s ON s.pos = t.jnid")(
    lambda g: sinks.tree_rows(g.tree, g.seq).withColumn("kids", F.size("kids").cast("long")).withColumnRenamed("kids", "n_kids")
)

# what a partition must be, whichever way it was made: every vertex once, no part over the cap, and no part's loads lost
_BOUNDS = _P + ", w AS (SELECT pos, count(lo) AS n FROM seq LEFT JOIN epos ON epos.lo = seq.pos GROUP BY pos) SELECT count(*) AS vertices, count(*) AS placed, sum(n)::BIGINT AS weight, 0::BIGINT AS over_cap FROM w"


def _bounds(g: Graph, k: int) -> DataFrame:
    parts = materialize(partition.tree_partition(g.tree, g.seq, k), "parts")
    whole = g.tree.agg(F.sum("pst_weight")).first()[0]
    loads = parts.join(g.seq, "vid").join(g.tree.withColumnRenamed("jnid", "pos"), "pos").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("vid").alias("d"), F.sum("pst_weight").alias("w"))
    over = F.count(F.when(F.col("w") > partition.capacity(whole, k), 1))
    return loads.agg(F.sum("n").alias("vertices"), F.sum("d").alias("placed"), F.sum("w").alias("weight"), over.alias("over_cap"))


for _k in (2, 4, 8):
    _query(f"gp_forward_bounds_k{_k}", _BOUNDS)(lambda g, k=_k: _bounds(g, k))


@_query("gp_efennel_bounds_k4", _E + ", n AS (SELECT count(*) AS m FROM e) SELECT src, dst, TRUE AS fits FROM e")
def _edge_bounds(g: Graph) -> DataFrame:
    """Each edge once, and in a part that has no more edges than the cap."""
    placed = materialize(partition.stream_edges(g.edges, 4), "placed")
    loads = placed.groupBy("part").agg((F.count("*") <= partition.capacity(g.edges.count(), 4)).alias("fits"))
    return placed.join(F.broadcast(loads), "part").select("src", "dst", "fits")


# files: what is written is read again


@_query("gp_text_edges_file", _E + " SELECT src, dst FROM e")
def _text_file(g: Graph) -> DataFrame:
    sinks.write_text_edges(g.edges, path := f"{g.folder}/graph.net")
    return graphs.read_edges(g.edges.sparkSession, path)


@_query("gp_binary_edges_file", _E + " SELECT src, dst, 1.0::FLOAT AS weight FROM e")
def _binary_file(g: Graph) -> DataFrame:
    sinks.write_binary_edges(g.edges, path := f"{g.folder}/graph.dat")
    return graphs.read_binary_edges(g.edges.sparkSession, path)


@_query("gp_partial_loads", _E + " SELECT src, dst FROM e")
def _partial_loads(g: Graph) -> DataFrame:
    """A graph file that three workers load in shares of its bytes; repeats in different shares go at last."""
    sinks.write_text_edges(g.edges.unionByName(g.edges.where("src % 2 = 0")), path := f"{g.folder}/graph.net")
    a, b, c = (graphs.read_edges(g.edges.sparkSession, path, k, 3, dedup=True) for k in range(3))
    return a.unionByName(b).unionByName(c).distinct()


@_query("gp_sequence_file", _S + " SELECT pos, vid FROM seq")
def _sequence_file(g: Graph) -> DataFrame:
    sinks.write_sequence(g.seq, path := f"{g.folder}/graph.seq")
    return graphs.read_sequence(g.edges.sparkSession, path)


@_query("gp_binary_sequence_file", _S + " SELECT pos, vid FROM seq")
def _binary_sequence_file(g: Graph) -> DataFrame:
    sinks.write_binary_sequence(g.seq, path := f"{g.folder}/graph.seq")
    return graphs.read_sequence(g.edges.sparkSession, path, binary=True)


@_query("gp_tree_file", _T + " SELECT jnid, parent, pst_weight FROM tree")
def _tree_file(g: Graph) -> DataFrame:
    sinks.write_tree(g.tree, path := f"{g.folder}/graph.tre")
    return graphs.read_tree(g.edges.sparkSession, path)


@_query("gp_partial_trees", _T + " SELECT jnid, parent, pst_weight FROM tree")
def _partial_trees(g: Graph) -> DataFrame:
    """A tree for each of two shares of a graph file, merged."""
    sinks.write_binary_edges(g.edges, path := f"{g.folder}/graph.dat")
    return tree.merge_trees(*(partitioning.partial_tree(g.edges.sparkSession, path, g.seq, k, 2) for k in range(2)))


@_query("gp_partition_file", _PARTS + " SELECT vid, part FROM parts")
def _partition_file(g: Graph) -> DataFrame:
    sinks.write_partition(g.hash_parts(), g.seq, path := f"{g.folder}/parts")
    return graphs.read_partition(g.edges.sparkSession, path, g.seq)


@_query("gp_partitioned_files", _ENDS + " SELECT least(x, y) AS src, greatest(x, y) AS dst, down_part AS part FROM j WHERE x < y")
def _partitioned_files(g: Graph) -> DataFrame:
    sinks.write_partitioned(ev.assign_edges(g.edges, g.hash_parts(), g.seq), path := f"{g.folder}/graph")
    ends = F.split("value", " ")
    return g.edges.sparkSession.read.text(path).select(ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst"), F.col("part").cast("int").alias("part"))


#: A file's edges as they come: either direction, and loops.
_FILE = _E.replace("e AS (", "e0 AS (") + ", e AS (SELECT CASE WHEN (src + dst) % 2 = 0 THEN src ELSE dst END AS src, CASE WHEN (src + dst) % 2 = 0 THEN dst ELSE src END AS dst FROM e0 UNION ALL SELECT src, src FROM e0 WHERE dst % 10 = 0)"
_FILE_N = _FILE + _ENDS[len(_E) :]


def _as_in_file(g: Graph) -> DataFrame:
    turned = (F.col("src") + F.col("dst")) % 2 != 0
    e = g.edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return e.unionByName(g.edges.where("dst % 10 = 0").select("src", F.col("src").alias("dst")))


@_query("gp_edge_assign_file", _FILE_N + " SELECT e.src, e.dst, CASE WHEN a.pos < b.pos THEN a.part ELSE b.part END AS part FROM e JOIN n a ON a.vid = e.src JOIN n b ON b.vid = e.dst")
def _assign_file(g: Graph) -> DataFrame:
    e = _as_in_file(g)
    return ev.assign_edges(e, partition.hash_partition(e, 4), sequence.degree_sequence(e), canonical=False)


@_query("gp_isomorphic_file", _FILE_N + ", iso AS (SELECT vid, row_number() OVER (ORDER BY part, pos) - 1 AS p FROM n) SELECT a.p AS src, b.p AS dst FROM e JOIN iso a ON a.vid = e.src JOIN iso b ON b.vid = e.dst")
def _isomorphic_file(g: Graph) -> DataFrame:
    e = _as_in_file(g)
    return ev.isomorphic(e, partition.hash_partition(e, 4), sequence.degree_sequence(e), canonical=False)


_query("gp_loops_degree", _FILE + ", d AS (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) SELECT x AS vid, count(*) AS degree FROM d GROUP BY x")(lambda g: sequence.degrees(_as_in_file(g)))
_OMITTED = _D + ", seq AS (SELECT row_number() OVER (ORDER BY degree, vid) - 1 AS pos, vid FROM (SELECT vid, degree FROM deg WHERE vid % 13 <> 5 UNION ALL SELECT -1 - v, 0 FROM range(3) AS t(v)))"
_OMITTED += ", near AS (SELECT a.pos AS lo, b.pos AS hi FROM d JOIN seq a ON a.vid = d.x LEFT JOIN seq b ON b.vid = d.y WHERE d.x <> d.y AND (b.pos IS NULL OR b.pos > a.pos)), epos AS (SELECT lo, hi FROM near WHERE hi IS NOT NULL)"


@_query("gp_omitted_vertices_tree", _OMITTED + _tree_of("seq").replace("FROM epos GROUP BY lo)", "FROM near GROUP BY lo)") + " SELECT jnid, parent, pst_weight FROM tree")
def _omitted(g: Graph) -> DataFrame:
    """A sequence that lacks some vertices, which come after all others, and has three that the graph lacks."""
    d = sequence.degrees(g.edges).where("vid % 13 <> 5")
    seq = sequence.ranked(d.unionByName(g.edges.sparkSession.range(3).select((-1 - F.col("id")).alias("vid"), F.lit(0).cast("long").alias("degree"))), "degree", "vid")
    return tree.build_tree(tree.positioned(g.edges, seq), seq)


_query("gp_vertex_hashes", _D + f" SELECT vid, {_HASH.format('vid')} AS golden, ((vid::HUGEINT * 2654435761) % 4294967296)::BIGINT AS prime, vid % 2 AS parity FROM deg")(
    lambda g: sequence.degrees(g.edges).select("vid", hashes.golden_hash(F.col("vid")).alias("golden"), hashes.prime_hash(F.col("vid")).alias("prime"), hashes.parity_hash(F.col("vid")).alias("parity"))
)
