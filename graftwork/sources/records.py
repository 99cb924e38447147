"""A data source for files of fixed binary records: edges, sequences and trees; and for shares of text edge files.

Files are read by ranges of bytes, a task for each, as Arrow batches. A file with a head, whose records have places, is written by all tasks at once: a record's
place gives its offset, so each task writes its rows where they belong in a file of the final size beside the target, and the commit step, if all
rows have come, renames it. A task that runs twice writes the same bytes again. Edges have no places: each task writes a file of its own to a
folder, and the commit step moves those that succeeded.

Paths are what pyarrow's file systems take; files with a head need one that all machines share and that allows writes at offsets.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The number that means "no parent", and the largest id that a record can hold.
NO_PARENT = 0xFFFFFFFF
MOST = NO_PARENT - 1
#: Of each kind of file the type of its head, which counts the records, and the record.
HEADS = {"edges": None, "sequence": "<u8", "tree": "<u4", "weighted_tree": "<u4"}
RECORDS = {
    "edges": [("src", "<u4"), ("dst", "<u4"), ("weight", "<f4")],
    "sequence": [("vid", "<u4")],
    "tree": [("parent", "<u4"), ("pst_weight", "<u4")],
    "weighted_tree": [("parent", "<u4"), ("pst_weight", "<u4"), ("pre_weight", "<u4")],
}
#: Bytes of a file that a task reads, and that it holds at a time.
SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
_EDGE = re.compile(rb"(?m)^[^\S\n]*(\d+)[^\S\n]+(\d+)")


def _schema(kind: str) -> str:
    if kind == "text":
        return "src long, dst long"
    columns = ", ".join(f"{c} {'float' if t == '<f4' else 'long'}" for c, t in RECORDS[kind])
    return columns if HEADS[kind] is None else f"place long, {columns}"


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file at a path, or those of a folder in the order of their names."""
    system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    info = system.get_file_info(inside)
    if info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.base_name[0] not in "_."]
        return system, sorted(found, key=lambda f: f.path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return system, [info]


def shares(sizes: list[int], part: int, parts: int, step: int, unit: int) -> list[tuple[int, int, int]]:
    """(file, from, to) of the tasks that read the ``part``-th of ``parts`` equal shares of all units of files of some sizes, at most ``step`` units each."""
    total, out, before = sum(s // unit for s in sizes), [], 0
    first, last = total * part // parts, total * (part + 1) // parts
    for k, s in enumerate(sizes):
        n = s // unit
        a, b = max(0, first - before), min(n, last - before)
        out += [(k, x, min(b, x + step)) for x in range(a, b, step)]
        before += n
    return out


@dataclass
class Share(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind, self.path = options["kind"], options["path"]
        self.part, self.parts = int(options.get("part", 0)), int(options.get("parts", 1))
        self.split = int(options.get("split", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, files = _files(self.path)
        if self.kind == "text":
            return [Share(files[k].path, a, b) for k, a, b in shares([f.size for f in files], self.part, self.parts, self.split, 1)] or [Share("", 0, 0)]
        head, size = HEADS[self.kind], np.dtype(RECORDS[self.kind]).itemsize
        skip = np.dtype(head).itemsize if head else 0
        for f in files:
            if (f.size - skip) % size or f.size < skip:
                raise ValueError(f"{f.path}: {f.size} bytes aren't whole records of {size} bytes")
            if head:
                with system.open_input_file(f.path) as src:
                    said = int(np.frombuffer(src.read(skip), head)[0])
                if said != (f.size - skip) // size:
                    raise ValueError(f"{f.path}: its head says {said} records, it has {(f.size - skip) // size}")
        if head and len(files) > 1:
            raise ValueError(f"{self.path}: records with places are read from one file")
        return [Share(files[k].path, a, b) for k, a, b in shares([f.size - skip for f in files], self.part, self.parts, max(1, self.split // size), size)] or [Share("", 0, 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if share.first >= share.last:
            return
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))
        with system.open_input_file(share.path) as src:
            yield from self._lines(src, share) if self.kind == "text" else self._records(src, share)

    def _records(self, src: pa.NativeFile, share: Share) -> Iterator[pa.RecordBatch]:
        kind, head = np.dtype(RECORDS[self.kind]), HEADS[self.kind]
        step = CHUNK_BYTES // kind.itemsize
        for a in range(share.first, share.last, step):
            n = min(step, share.last - a)
            src.seek((np.dtype(head).itemsize if head else 0) + a * kind.itemsize)
            rows = np.frombuffer(src.read(n * kind.itemsize), kind)
            cols = [pa.array(rows[c]) if kind[c].kind == "f" else pa.array(rows[c].astype(np.int64), mask=rows[c] == NO_PARENT if c == "parent" else None) for c in kind.names]
            names = list(kind.names)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *cols] if head else cols, ["place", *names] if head else names)

    def _lines(self, src: pa.NativeFile, share: Share) -> Iterator[pa.RecordBatch]:
        """Edges of the lines that begin in the share; only the end of the last one is read beyond it."""
        at, rest, skip = share.first, b"", share.first > 0
        if skip:  # the line that is under way here belongs to the share before, unless it ended just before
            at -= 1
        src.seek(at)
        while True:
            chunk = src.read(min(CHUNK_BYTES, share.last - at)) if at < share.last else b""
            at += len(chunk)
            data = rest + chunk
            if skip:
                end = data.find(b"\n")
                if end < 0:
                    if not chunk:
                        return
                    continue
                data, skip = data[end + 1 :], False
            if not chunk:
                while data and not data.endswith(b"\n") and (more := src.read(256)):
                    end = more.find(b"\n")
                    data += more if end < 0 else more[: end + 1]
            cut = data.rfind(b"\n") + 1 if chunk else len(data)
            rest = data[cut:]
            found = _EDGE.findall(data[:cut])
            if found:
                pairs = np.array(found).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])
            if not chunk:
                return


@dataclass
class Written(WriterCommitMessage):
    rows: int
    name: str


class Writer(DataSourceArrowWriter):
    """``aside``: the file, or folder, that is written before it takes its place."""

    def __init__(self, options: dict, names: list[str]) -> None:
        self.kind, self.path, self.aside, self.rows, self.names = options["kind"], options["path"], options["aside"], int(options["rows"]), names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        record = np.dtype(RECORDS[self.kind])
        name = "" if HEADS[self.kind] else f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with open(f"{self.aside}/{name}", "wb") if name else open(self.aside, "r+b") as out:
            rows = 0
            for batch in iterator:
                data = np.empty(batch.num_rows, record)
                for c in record.names:
                    col = batch.column(self.names.index(c)) if c in self.names else pa.array(np.ones(batch.num_rows, np.float32))
                    if record[c].kind == "f":
                        data[c] = col.to_numpy(zero_copy_only=False)
                        continue
                    if col.null_count and c != "parent":
                        raise ValueError(f"{c} has a null, which a record can't hold")
                    values = col.fill_null(0).to_numpy(zero_copy_only=False)
                    if len(values) and (values.min() < 0 or values.max() > MOST):
                        raise ValueError(f"{c} has {values.min() if values.min() < 0 else values.max()}, a record holds 0 to {MOST}")
                    data[c] = np.where(col.is_null().to_numpy(zero_copy_only=False), NO_PARENT, values)
                rows += len(data)
                if name:
                    out.write(data.tobytes())
                    continue
                place = batch.column(self.names.index("place")).to_numpy()
                if len(place) and (place.min() < 0 or place.max() >= self.rows):
                    raise ValueError("places must be 0 to the number of records less 1, each once")
                cuts = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        out.seek(np.dtype(HEADS[self.kind]).itemsize + int(place[a]) * record.itemsize)
                        out.write(data[a:b].tobytes())
        return Written(rows, name)

    def commit(self, messages: list[Written]) -> None:
        done = [m for m in messages if m is not None]
        if sum(m.rows for m in done) != self.rows:
            self.abort(messages)
            raise ValueError(f"{sum(m.rows for m in done)} records came of {self.rows}")
        if HEADS[self.kind]:
            os.replace(self.aside, self.path)
            return
        os.makedirs(self.path)
        for k, m in enumerate(sorted((m for m in done if m.rows), key=lambda m: m.name)):
            os.replace(f"{self.aside}/{m.name}", f"{self.path}/part-{k:06d}")

    def abort(self, messages: list[Written]) -> None:
        if HEADS[self.kind] and os.path.exists(self.aside):
            os.remove(self.aside)


class Records(DataSource):
    """Options: kind, path; reading: part, parts (a share), split (bytes of a task); writing: rows, aside."""

    @classmethod
    def name(cls) -> str:
        return "graph_records"

    def schema(self) -> str:
        return _schema(self.options["kind"])

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names)


def read_records(spark: SparkSession, path: str, kind: str, part: int = 0, parts: int = 1, split: int = SPLIT_BYTES) -> DataFrame:
    """A file of records, or the ``part``-th (from 0) of ``parts`` equal shares of it."""
    if not 0 <= part < parts:
        raise ValueError("a part is a number from 0 to the number of parts less 1")
    spark.dataSource.register(Records)
    return spark.read.format("graph_records").options(kind=kind, path=path, part=part, parts=parts, split=split).load()


def write_records(df: DataFrame, path: str, kind: str) -> None:
    """``df`` must have the columns of the kind; with a head, ``place`` too: 0, 1, ... each once. Numbers that a record can't hold are an error."""
    path = path.removeprefix("file://")
    if os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    df.sparkSession.dataSource.register(Records)
    head, aside = HEADS[kind], f"{path}.{uuid.uuid4().hex}.part"
    rows = df.count()
    if head:
        if df.agg(F.count_distinct("place").alias("n")).first()["n"] != rows:
            raise ValueError("places must be 0 to the number of records less 1, each once")
        with open(aside, "wb") as f:
            f.write(np.array([rows], head).tobytes())
            f.truncate(np.dtype(head).itemsize + rows * np.dtype(RECORDS[kind]).itemsize)
        df = df.repartitionByRange("place").sortWithinPartitions("place")
    else:
        os.makedirs(aside)
    df.write.format("graph_records").mode("append").options(kind=kind, path=path, aside=aside, rows=rows).save()
    if not head:
        os.rmdir(aside) if not os.listdir(aside) else None
