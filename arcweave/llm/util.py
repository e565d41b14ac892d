"""Rows of a table by their key without moving them, and connected components."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.storage import filesystem, materialize, new_path, release, shared_dir, write_whole  # noqa: F401


#: Bytes of the Arrow batches in which texts go to Python workers; Spark's 64 MB, twice over while they grow, would be held
#: by every task on both sides.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after setting its session's limit of bytes for such batches to at most BATCH_BYTES; no result depends on it."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name).removesuffix("b")
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def _marks(rows: DataFrame, ids: DataFrame, key: str) -> str | None:
    """A folder with a bitmap for each file of rows, one bit a row, set where the row's key is among ids; None where rows
    don't come straight from files that number their rows. Ids and row numbers move, nothing else of the rows does."""
    if "_metadata" in rows.columns:
        return None
    try:
        at = rows.select(F.md5(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row"), F.col(key).cast("long").alias("key"))
    except AnalysisException:
        return None
    folder = new_path(rows.sparkSession, "marks")
    hit = at.join(ids.select(F.col(key).cast("long").alias("key")), "key", "left_semi")
    words = hit.groupBy("file", F.expr("row div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(row % 64 AS int)))").alias("bits"))
    held = words.groupBy("file").agg(F.collect_list(F.struct("word", "bits")).alias("words"))  # a word for 64 rows of one file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.column(1)[i].values
                word = flat.field("word").to_numpy()
                bits = np.zeros(int(word.max()) + 1, "<i8")
                bits[word] = flat.field("bits").to_numpy()
                write_whole(system, posixpath.join(root, batch.column(0)[i].as_py()), bits.tobytes(), TaskContext.get().taskAttemptId())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    held.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
    return folder


def _chosen(rows: DataFrame, folder: str, marked: bool) -> DataFrame:
    """The rows whose bit is set, or isn't; all columns as they were."""
    file, row = _free(rows, "__file"), _free(rows, "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)

        @lru_cache(2)
        def bits(name: str) -> np.ndarray:
            path = posixpath.join(root, name)
            if not system.get_file_info(path).is_file:
                return np.zeros(0, np.uint64)
            with system.open_input_stream(path) as f:
                return np.frombuffer(f.read(), np.uint64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small batches back: rows may hold long texts
                part = batch.slice(at, 256)
                names, spot = part.column(part.num_columns - 2), part.column(part.num_columns - 1).to_numpy()
                on = np.zeros(len(spot), bool)
                for name in names.unique().to_pylist():
                    mine = np.flatnonzero(names.to_numpy(zero_copy_only=False) == name)
                    have = bits(name)
                    inside = mine[spot[mine] >> 6 < len(have)]
                    s = spot[inside]
                    on[inside] = (have[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
                kept = part.filter(pa.array(on == marked))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays(kept.columns[:-2], names=kept.schema.names[:-2])
            pa.default_memory_pool().release_unused()

    return rows.withColumns({file: F.md5(F.col("_metadata.file_path")), row: F.col("_metadata.row_index")}).mapInArrow(run, rows.schema)


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ids (a table with that one column), exactly. Rows that come straight from Parquet files are
    found in place by bitmaps of their files, and stay where they are; others are joined. A null key is in no ids."""
    folder = _marks(rows, ids, key)
    return _chosen(rows, folder, True) if folder else rows.join(ids, key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ids, found like those of among(). A null key stays."""
    folder = _marks(rows, ids, key)
    if folder:
        return _chosen(rows, folder, False)
    gone = ids.select(F.col(key).cast("long").alias("__gone"))
    return rows.join(gone, rows[key].cast("long") == gone["__gone"], "left_anti")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group): for every id in edges(a, b), the smallest id that it is connected with.

    Large-star and small-star rounds. Minima are aggregated before they move and meet their edges in a join, which splits
    skewed partitions, so an id with very many edges isn't one task's. Rounds grow with the logarithm of the longest
    chain; more than `rounds` are an error. Null ends and loops are ignored."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e, "components")
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "components")
        m = large.join(least(large), "u")
        small = m.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u <> v").distinct(), "components")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(large)
        release(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
