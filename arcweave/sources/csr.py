"""Compressed sparse rows in one file: a mark, version, n, m, then offsets and neighbours forward and backward, as
little-endian 32-bit numbers. Files are named by a path or a URI that all machines reach. Read in blocks of nodes by as many
tasks as wanted; written by the tasks of sorted range partitions, whose parts the driver only joins."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcweave import storage
from arcweave.operators import graph

MARK, VERSION = b"WGCS", 1
HEAD = 16
BLOCK = 1 << 20
KIND = np.dtype("<u4")


def header(path: str) -> tuple[int, int]:
    """(n, m); anything but a whole file of this format is an error."""
    system, name = storage.filesystem(path)
    with system.open_input_file(name) as f:
        size = f.size()
        head = f.read_at(min(HEAD, size), 0)
    if len(head) < HEAD or head[:4] != MARK:
        raise ValueError("not a graph file")
    version, n, m = np.frombuffer(head[4:], KIND).tolist()
    if version != VERSION:
        raise ValueError(f"version {version} of the graph format, not {VERSION}")
    if size != HEAD + 4 * (2 * (n + 1) + 2 * m):
        raise ValueError("the graph file is cut short")
    return n, m


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    def __init__(self, path: str, backward: bool) -> None:
        self.path, self.backward = path, backward

    def partitions(self) -> list[Rows]:
        n, _ = header(self.path)
        return [Rows(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        n, m = header(self.path)
        base = HEAD + (4 * (n + 1 + m) if self.backward else 0)
        system, name = storage.filesystem(self.path)
        with system.open_input_file(name) as f:
            numbers = lambda at, count: np.frombuffer(f.read_at(4 * count, base + 4 * at), KIND).astype(np.int64)
            offsets = numbers(part.first, part.last - part.first + 1)
            ids = np.repeat(np.arange(part.first, part.last), np.diff(offsets))
            for at in range(0, len(ids), 1 << 16):
                own = ids[at : at + (1 << 16)]
                other = numbers(n + 1 + int(offsets[0]) + at, len(own))
                src, dst = (other, own) if self.backward else (own, other)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


class CsrSource(DataSource):
    """spark.read.format("csr").option("path", file).load(): (src, dst); option backward reads the reverse half."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], self.options.get("backward", "false").lower() == "true")


def read(spark: SparkSession, path: str, backward: bool = False) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").option("path", path).option("backward", str(backward)).load()


def _parts(sorted_: DataFrame, folder: str) -> list[tuple[int, int]]:
    """Write the one column of a range-partitioned table, a file a partition; (partition, numbers) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = storage.filesystem(folder)
        system.create_dir(root, recursive=True)
        name, many = posixpath.join(root, f"part-{task.partitionId():06d}"), 0
        trial = f"{name}.{task.taskAttemptId()}"
        with system.open_output_stream(trial) as out:
            for batch in batches:
                numbers = batch.column(0).to_numpy().astype(KIND)
                out.write(numbers.tobytes())
                many += len(numbers)
        system.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([many], pa.int64())], names=["part", "many"])

    return sorted((r["part"], r["many"]) for r in sorted_.mapInArrow(run, "part int, many long").collect())


def write(edges: DataFrame, path: str, n: int | None = None) -> tuple[int, int]:
    """Write edges (src, dst) and their reverse; returns (n, m). The format is one file, so one process must join the parts;
    it copies bytes, a row a partition tells it their order."""
    bounds = edges.agg(F.greatest(F.max("src"), F.max("dst")).alias("top"), F.least(F.min("src"), F.min("dst")).alias("low"), F.count("*").alias("m")).first()
    n = n if n is not None else (bounds["top"] + 1 if bounds["m"] else 0)
    if bounds["m"] and (bounds["low"] < 0 or bounds["top"] >= n or bounds["top"] >= 1 << 32 or bounds["m"] >= 1 << 32):
        raise ValueError("ids must be 32-bit and below n")
    system, name = storage.filesystem(path)
    with system.open_output_stream(name) as f:
        f.write(MARK + np.array([VERSION, n, bounds["m"]], KIND).tobytes())
        for own, other in (("src", "dst"), ("dst", "src")):
            first = graph.offsets(edges, own, n).repartitionByRange("id").sortWithinPartitions("id").select("first")
            held = edges.select("src", "dst").repartitionByRange(own).sortWithinPartitions(own, other).select(other)
            for table, want in ((first, n + 1), (held, bounds["m"])):
                folder = storage.new_path(edges.sparkSession, "csr")
                parts = _parts(table, folder)
                if sum(many for _, many in parts) != want:
                    raise ValueError("the edges changed while they were written")
                held_at, root = storage.filesystem(folder)
                for part, many in parts:
                    with held_at.open_input_stream(posixpath.join(root, f"part-{part:06d}")) as g:
                        while block := g.read(1 << 22):
                            f.write(block)
                storage.delete(edges.sparkSession, folder)
    return n, bounds["m"]
