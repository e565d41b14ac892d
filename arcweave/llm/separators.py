"""Token counts of documents in flat token files that have no index: only an end-of-document id between documents.

The files are cut into blocks of a fixed number of tokens. One task searches a block with one vectorised comparison and
tells where the separators stand; a prefix scan over the blocks of a file (how many separators came before, and where the
last one stood) then stitches documents that span blocks, however many. The scan sees one short row a block, never tokens.

pack() writes such files from a table of texts, with a manifest that names the documents in their order.

Defined results. Adjacent separators bound an empty document of 0 tokens; an empty text is one. Tokens after the last
separator are a document whose column terminated is false; an empty file has none. A very long document spans as many
blocks as it needs; one text is encoded in one task. Files and positions are unique, so there are no ties. A null text isn't packed (there is no
document to count), a null doc_id is carried along, repeated rows are packed as often as they come. Files whose length is
no multiple of the token width are an error. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm import textnum, util

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
WIDTH = 2
BLOCK = 1 << 21


@lru_cache(2)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Write the texts' tokens to flat files in folder, one a partition, each document ended by the separator.
    Returns the manifest (file, position, doc_id), materialised. A task writes to its own name and renames when it is
    complete, so one that is tried again, or twice at once, leaves one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("doc_id", pa.int64())])
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.tok"
        system, root = util.filesystem(folder)
        system.create_dir(root, recursive=True)
        trial = posixpath.join(root, f".{name}.{task.taskAttemptId()}")
        enc, kind, at = encoding(vocabulary), np.dtype(f"<u{width}"), 0
        with system.open_output_stream(trial) as out:
            for batch in batches:
                for part in textnum.pieces(batch, "text"):
                    for t in part.column(1).to_pylist():
                        out.write(np.append(np.array(enc.encode_ordinary(t), kind), kind.type(separator)).tobytes())
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n)), part.column(0)], schema=schema)
                    at += n
        system.move(trial, posixpath.join(root, name))

    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return util.materialize(docs.mapInArrow(run, "file string, position long, doc_id long"), "manifest")


def separators(tokens: np.ndarray, separator: int) -> np.ndarray:
    return np.flatnonzero(tokens == separator)


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, position, start_token, n_tokens, terminated) of every document in the folder's token files."""
    system, root = util.filesystem(folder)
    from pyarrow import fs

    listed = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
    for f in listed:
        if f.size % width:
            raise ValueError(f"{f.base_name}: {f.size} bytes aren't whole tokens of {width}")
    files = spark.createDataFrame([(f.base_name, f.size // width) for f in listed], "file string, tokens long")
    span = F.expr(f"sequence(0L, (tokens - 1) div {block})")
    blocks = files.where("tokens > 0").select("file", "tokens", F.explode(span).alias("block")).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("ends", pa.list_(pa.int64()))])
        system, root = util.filesystem(folder)
        for batch in batches:
            for file, tokens, k in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(posixpath.join(root, file)) as f:
                    data = np.frombuffer(f.read_at(min(block, tokens - k * block) * width, k * block * width), f"<u{width}")
                ends = separators(data, separator) + k * block
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    seen = util.materialize(blocks.mapInArrow(run, "file string, block long, tokens long, ends array<long>"), "blocks")
    short = seen.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("tail"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = short.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("tail").over(before), F.lit(-1)).alias("last"))
    inner = (
        seen.join(scan, ["file", "block"])
        .select("file", "base", "last", "ends", F.posexplode("ends").alias("i", "end"))
        .select("file", (F.col("base") + F.col("i")).alias("position"), (F.when(F.col("i") == 0, F.col("last")).otherwise(F.expr("get(ends, i - 1)")) + 1).alias("start_token"), "end", F.lit(True).alias("terminated"))
    )
    rest = seen.groupBy("file").agg(F.sum(F.size("ends")).cast("long").alias("position"), (F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1)) + 1).alias("start_token"), F.first("tokens").alias("end")).where("start_token < end").withColumn("terminated", F.lit(False))
    return inner.unionByName(rest).select("file", "position", "start_token", (F.col("end") - F.col("start_token")).alias("n_tokens"), "terminated")


def document_token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack documents to flat files in the shared folder, find the separators again, and name the documents:
    (doc_id, file, position, start_token, n_tokens)."""
    spark = documents.sparkSession
    folder = util.new_path(spark, "tokens")
    manifest = pack(documents, folder, vocabulary)
    return manifest.join(count_tokens(spark, folder), ["file", "position"]).select("doc_id", "file", "position", "start_token", "n_tokens")
