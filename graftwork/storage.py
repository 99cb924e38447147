"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, in local mode, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="graftwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/graftwork/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: A table of at most so many bytes is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def fits_broadcast(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows of a table, counted first where their number isn't known, come to at most BROADCAST_BYTES."""
    rows = getattr(df, "_rows", None)
    return (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` made, once everything that was made of them is stored itself."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._stored_at
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
