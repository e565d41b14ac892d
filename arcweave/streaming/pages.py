"""Pages that arrive in files over time, through the same column expressions as a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweave.operators import extract


def read_links(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of (source, target) from the XML files that arrive in folder, at most `files` a batch."""
    raw = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files).text(folder)
    xml = raw.where(F.col("value").contains("<page>")).select(F.concat("value", F.lit("</page>")).alias("xml"))
    return extract.extract_links(extract.classify(extract.parse_pages(extract.split_pages(xml))))


def write_links(links: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the links to a Parquet table; with `once`, take what is there and end."""
    out = links.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def degrees(links: DataFrame) -> DataFrame:
    """(title, links) so far, as a running aggregate: the state holds one row a title."""
    return links.groupBy(F.col("source").alias("title")).agg(F.count("*").alias("links"))
