"""WARC records and a Merkle fixity audit of two replicas, in DataFrame functions.

A record's leaf is the hash of its bytes. Level l of the tree has a node for each range of FANOUT^l record numbers; a node's hash is
over its children's hashes and lengths in order, so it stands for an ordered range of offsets. Two replicas are compared from
the root: where hashes differ, the children are compared, and so on down to the records; equal branches aren't visited.
A node has FANOUT children at most, whatever the data's size; levels shrink by FANOUT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 16
#: Records of a WARC file.
FILE_RECORDS = 1024


def _over(x: Column, by: int) -> Column:
    """x over ``by``, a power of two, rounded down, in whole numbers."""
    return F.shiftright(x, by.bit_length() - 1)


def record(url: Column, body: Column) -> Column:
    """A response record: header, empty line, body, two line ends. A null or empty url or body counts as empty."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(df: DataFrame, number: Column, payload: Column) -> DataFrame:
    """number, file, offset, length, hash of each record; files hold FILE_RECORDS numbers, records in their order.

    Records of one number, which a sound archive hasn't, are one leaf: its length is their sum, its hash is over their number
    and an order-free sum of their hashes. Records without a number are one leaf, that has a null number, no file and no offset.
    Other columns are ignored; an empty table has no leaves.
    """
    rows = df.select(number.cast("long").alias("number"), payload.alias("p")).select("number", F.octet_length("p").cast("long").alias("length"), F.sha2("p", 256).alias("h"))
    one = rows.groupBy("number").agg(F.sum("length").alias("length"), F.sha2(F.concat_ws("|", F.min("h"), F.max("h"), F.count("*").cast("string"), F.bit_xor(F.xxhash64("h")).cast("string"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).cast("string")), 256).alias("hash"))
    one = one.withColumn("file", _over(F.col("number"), FILE_RECORDS))
    before = W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    return one.select("number", "file", F.when(F.col("number").isNotNull(), F.coalesce(F.sum("length").over(before), F.lit(0))).cast("long").alias("offset"), "length", "hash")


def tree(records: DataFrame, base: int, levels: int) -> list[DataFrame]:
    """Nodes (node, up, length, hash) of every level, the records' own first; each level is stored."""
    out = [records.select((F.col("number") - base).alias("node"), "length", "hash")]
    for _ in range(levels):
        up = _over(F.col("node"), FANOUT)
        kids = F.sort_array(F.collect_list(F.struct("node", "length", "hash")))
        text = F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["node"].cast("string"), x["length"].cast("string"), x["hash"])), "|")
        out.append(materialize(out[-1].groupBy(up.alias("node")).agg(F.sum("length").alias("length"), F.sha2(text, 256).alias("hash")), "merkle"))
    return out


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of which two replicas (see ``leaves``) differ: number, kind (changed, missing, extra), file, offset, length.

    missing: the second replica lacks it; place and length are the first's, or the second's for an extra one. Two empty
    replicas, and equal ones, give no row. Leaves without a number are in no tree; they are compared with each other.
    """
    both = [materialize(x, "replica") for x in (first, second)]
    kind = lambda a, b: F.when(F.col(b).isNull(), "missing").when(F.col(a).isNull(), "extra").otherwise("changed")
    x, y = (z.where("number is null").select(F.lit(0).alias("k"), F.col("length").alias(f"length_{s}"), F.col("hash").alias(f"hash_{s}")) for z, s in zip(both, "ab", strict=True))
    none = F.lit(None).cast("long")
    unnumbered = x.join(y, "k", "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(none.alias("number"), kind("hash_a", "hash_b").alias("kind"), none.alias("file"), none.alias("offset"), F.coalesce("length_a", "length_b").alias("length"))
    first, second = (z.where("number is not null") for z in both)
    lo, hi = first.select("number").union(second.select("number")).agg(F.min("number"), F.max("number")).first()
    levels, span = 0, (hi - lo + 1) if lo is not None else 1
    while FANOUT**levels < span:
        levels += 1
    a, b = tree(first, lo or 0, levels), tree(second, lo or 0, levels)
    bad = None
    for level in range(levels, -1, -1):
        x, y = (t[level].select(F.col("node").alias(f"node_{s}"), F.col("hash").alias(f"hash_{s}")) for t, s in ((a, "a"), (b, "b")))
        if bad is not None:
            x, y = (z.join(bad, _over(F.col(f"node_{s}"), FANOUT) == F.col("bad"), "left_semi") for z, s in ((x, "a"), (y, "b")))
        differ = x.join(y, F.col("node_a") == F.col("node_b"), "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        bad = materialize(differ.select(F.coalesce("node_a", "node_b").alias("bad"), kind("node_a", "node_b").alias("kind")), "differ")
        if bad.isEmpty():
            break
    at = bad.select((F.col("bad") + (lo or 0)).alias("number"), "kind")
    place = ["file", "offset", "length"]
    gone = at.where("kind <> 'extra'").join(first.select("number", *place), "number")
    return unnumbered.unionByName(gone).unionByName(at.where("kind = 'extra'").join(second.select("number", *place), "number"))
