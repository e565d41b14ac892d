"""Compressed page dumps with an index of stream offsets, and NDJSON search documents."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import schemas
from arcweave.operators import extract


def index_offsets(lines: DataFrame) -> DataFrame:
    """(start, end) of the streams that an index (value: `offset:page:title`) names; the last has no end. Offsets are few,
    one for a hundred pages, so one task orders them."""
    start = lines.select(F.split("value", ":", 2)[0].cast("bigint").alias("start")).distinct()
    return start.select("start", F.lead("start").over(Window.orderBy("start")).alias("end"))


def read_streams(path: str, ranges: DataFrame) -> DataFrame:
    """(start, xml): each byte range read and decompressed where a task needs it; broken UTF-8 becomes U+FFFD."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with system.open_input_file(name) as f:
            for frame in frames:
                for start, end in zip(frame["start"], frame["end"]):
                    stop = f.size() if pd.isna(end) else int(end)
                    raw = bz2.decompress(f.read_at(stop - int(start), int(start)))
                    yield pd.DataFrame({"start": [start], "xml": [raw.decode("utf-8", "replace")]})

    return ranges.repartition("start").mapInPandas(run, "start bigint, xml string")


def read_dump(spark: SparkSession, dump: str, index: str) -> DataFrame:
    """(title, body, is_redirect, redirect_target) of a dump with its index; Spark decompresses the index itself."""
    chunks = read_streams(dump, index_offsets(spark.read.text(index)))
    return extract.classify(extract.parse_pages(extract.split_pages(chunks)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(xml) of a dump without an index: the text reader cuts, also inside bz2, at the end of each page."""
    return spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<page>")).select(F.concat("value", F.lit("</page>")).alias("xml"))


def read_search_docs(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON search documents; a malformed line is an error, no aliases are an empty list."""
    docs = spark.read.schema(schemas.SEARCH_DOC).option("mode", "FAILFAST").json(path)
    return docs.withColumn("a", F.coalesce("a", F.expr("cast(array() AS array<string>)")))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
