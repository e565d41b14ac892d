"""The whole build as stages that are skipped where their table is complete, and what is served from it."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators import community, extract, graph, layout, overlap, records, search
from arcweave.sinks import files
from arcweave.sources import pmtiles


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at path, made first if it isn't complete (or if `again`)."""
    if again or not exists(spark, path):
        files.parquet(make(), path)
    return spark.read.parquet(path)


def build(spark: SparkSession, xml: DataFrame, folder: str, passes: tuple[layout.Pass, ...] = layout.PASSES) -> dict[str, DataFrame]:
    """From page XML to enriched nodes, edges and aliases in folder. The merge is made anew each time."""
    at = lambda name, make, again=False: stage(spark, f"{folder}/{name}", make, again)
    parsed = at("parsed", lambda: extract.classify(extract.parse_pages(extract.split_pages(xml))))
    nodes = at("nodes", lambda: extract.build_nodes(parsed))
    raw = parsed.where("is_redirect").select(F.col("title").alias("alias"), F.col("redirect_target").alias("target"))
    moved = at("redirects", lambda: extract.resolve_redirects(raw))
    edges = at("edges", lambda: extract.build_edges(extract.extract_links(parsed), nodes, moved))
    aliases = at("aliases", lambda: extract.build_aliases(moved, nodes))
    ranked = at("pagerank", lambda: graph.pagerank(edges))
    pairs = at("pairs", lambda: graph.undirected(edges))
    groups = at("clusters", lambda: community.leiden(pairs).withColumnRenamed("label", "partition"))
    placed = at("layout", lambda: layout.layout(pairs, layout.radii(ranked), passes))
    merged = at("initial_nodes", lambda: records.enrich(nodes, ranked, groups, placed), True)
    enriched = at("enriched_nodes", lambda: overlap.relax(merged))
    return {"nodes": enriched, "edges": edges, "aliases": aliases}


def serve_search(index: search.Index, query: str, n: int | None = None) -> DataFrame:
    return search.search(index, query, n).drop("score")


def serve_path(edges: DataFrame, docs: DataFrame, source: int, target: int) -> DataFrame:
    return graph.path(edges, docs, source, target)


_TILE = re.compile(r"/([\w/!.*'()-]+)/(\d+)/(\d+)/(\d+)\.([a-z]+)")
_INFO = re.compile(r"/([\w/!.*'()-]+)\.json")


def parse_url(path: str) -> dict | None:
    """{name, z, x, y, ext} of a tile, {name} of a description, None of anything else."""
    if m := _TILE.fullmatch(path):
        return {"name": m[1], "z": int(m[2]), "x": int(m[3]), "y": int(m[4]), "ext": m[5]}
    if m := _INFO.fullmatch(path):
        return {"name": m[1]}
    return None


def serve_tile(archive: str, z: int, x: int, y: int) -> tuple[int, str, bytes]:
    """(status, content type, bytes): 404 beyond the archive's zooms, 204 where it has no tile. Gzipped tiles come unpacked."""
    head = pmtiles.read_header(archive)
    if not head.min_zoom <= z <= head.max_zoom:
        return 404, "", b""
    data = pmtiles.lookup(archive, z, x, y)
    if data is None:
        return 204, "", b""
    if head.compression == pmtiles.GZIP:
        data = gzip.decompress(data)
    elif head.compression > pmtiles.GZIP:
        raise ValueError("this compression can't be read")
    return 200, pmtiles.CONTENT.get(head.kind, "application/octet-stream"), data
