"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def filesystem(path: str):
    """(file system, path in it) of a path or a URI, for single files that any machine must reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_whole(system, path: str, data: bytes, attempt: int) -> None:
    """A file that is there as a whole or not at all, also where a task is tried again or twice at once."""
    trial = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{attempt}")
    with system.open_output_stream(trial) as out:
        out.write(data)
    system.move(trial, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary one; a cluster
    must name it, because a folder of one machine is lost with that machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arcweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arcweave_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    if path := getattr(df, "_arcweave_path", None):
        delete(df.sparkSession, path)
        df._arcweave_path = None


def by_one(tables: Sequence[DataFrame], run: Callable[..., dict], schema: str, name: str) -> DataFrame:
    """The columns (a dict of arrays) that run makes of whole tables of materialize(), which one task reads as Arrow tables.
    For loops of many short rounds over numbers that fit a task; the caller bounds the tables."""
    held = [(t._arcweave_path, t.columns) for t in tables]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for _ in batches:
            got = []
            for path, columns in held:
                system, root = filesystem(path)
                got.append(parquet.read_table(root, columns=columns, filesystem=system))
            yield from pa.table(run(*got)).to_batches(max_chunksize=1 << 16)

    return materialize(tables[0].sparkSession.range(0, 1, 1, 1).mapInArrow(task, schema), name)


class Growing:
    """A table in the shared folder to which rows are appended; each append is one job, and read() sees all so far."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.schema, self.path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
        df.coalesce(1).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def release(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path()."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None:
            continue
        try:
            delete(spark, path)
        except Exception as e:  # the JVM may have gone first
            print(f"left behind {path}: {type(e).__name__}")
