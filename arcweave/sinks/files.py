"""Parquet tables, NDJSON and the statistics file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import storage


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def ndjson(df: DataFrame, path: str) -> None:
    """One compact object a line, in the order of the columns; nulls are written, and null lists of names as empty ones."""
    cols = [F.coalesce(F.col(c), F.expr("cast(array() AS array<string>)")).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def meta_json(totals: DataFrame, clusters: DataFrame, path: str) -> dict:
    """Totals and the clusters, largest first. One row a cluster comes to the driver."""
    t = totals.first()
    rows = clusters.orderBy(F.col("count").desc(), "id").toLocalIterator()
    out = {"total_pages": t["total_pages"], "total_links": t["total_links"], "clusters": [{"id": r["id"], "color": [r["r"], r["g"], r["b"]], "count": r["count"], "name": r["name"]} for r in rows]}
    system, name = storage.filesystem(path)
    with system.open_output_stream(name) as f:
        f.write(json.dumps(out, indent=2, ensure_ascii=False).encode())
    return out
