"""Graphs, sequences, trees and partitions from files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import checked, distinct_edges, ranked
from .records import read_records


def edges_from(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")


def supplier_part(spark: SparkSession, sf_dir: str, offset: int = 1_000_000, distinct: bool = True) -> DataFrame:
    """Suppliers and the parts they deliver; part ids are moved by ``offset`` to keep both ranges apart."""
    e = edges_from(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", (F.col("l_partkey") + offset).alias("part")), "l_suppkey", "part")
    return distinct_edges(e) if distinct else e


def read_text_edges(spark: SparkSession, path: str) -> DataFrame:
    """Two numbers a line, split by white space. Lines that don't begin with two numbers, comments among them, are left out."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s+\d+"))
    return lines.select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"))


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """Records of 12 bytes: tail, head, weight; a file or a folder of them. Each record is delivered once; bytes after the last whole one are an
    error. Files are read by ranges of bytes."""
    return read_records(spark, path, "edges")


def read_edges(spark: SparkSession, path: str, part: int | None = None, parts: int | None = None, dedup: bool = False) -> DataFrame:
    """By suffix: .dat is binary, all else text. ``part`` of ``parts`` (from 0) loads that share of the file's bytes, and reads no others; a
    line belongs to the share that it begins in."""
    kind = "edges" if path.endswith(".dat") else "text"
    if parts is not None:
        e = read_records(spark, path, kind, part or 0, parts)
    else:
        e = (read_binary_edges if kind == "edges" else read_text_edges)(spark, path)
    return distinct_edges(e.select("src", "dst")) if dedup else e.select("src", "dst")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a text file of one number a line, in the file's order."""
    lines = spark.read.text(path).select(F.col("value").cast("long").alias("vid"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).where("vid is not null")
    return ranked(lines, "f", "b", "i")


def read_sequence(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(pos, vid); binary: a 64-bit count and 32-bit ids. A vertex that stands twice is an error."""
    if not binary:
        return checked(read_lines(spark, path))
    return checked(read_records(spark, path, "sequence").withColumnRenamed("place", "pos"))


def read_partition(spark: SparkSession, path: str, seq: DataFrame) -> DataFrame:
    """parts(vid, part) from one part a line, in the order of the sequence, which must be as long. The number of parts is the largest + 1."""
    lines = read_lines(spark, path)
    vertices = seq.count()
    if lines._rows != vertices:
        raise ValueError(f"{path} has {lines._rows} parts for {vertices} vertices")
    return lines.select("pos", F.col("vid").cast("int").alias("part")).join(seq, "pos").select("vid", "part")


def read_tree(spark: SparkSession, path: str, pre_weight: bool = False) -> DataFrame:
    """tree(jnid, parent, pst_weight[, pre_weight]) from a tree file: the count, then the records."""
    return read_records(spark, path, "weighted_tree" if pre_weight else "tree").withColumnRenamed("place", "jnid")
