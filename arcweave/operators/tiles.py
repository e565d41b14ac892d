"""Tiles: which nodes a tile holds, its encoding, its picture, and the slots of the page archive."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions import geometry
from arcweave.functions.geometry import TILE_PX, WORLD

SAMPLES = 4
LEAST_PX = 5.0
ROUGH_PX = 10.0


def zooms(df: DataFrame, most: int) -> DataFrame:
    """Every row once for each zoom from 0 to `most`."""
    return df.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(most))))


def _inside(*axis: str) -> Column:
    side = F.expr("1 << z")
    out = F.lit(True)
    for a in axis:
        out = out & (F.col(a) >= 0) & (F.col(a) < side)
    return out


def touched(nodes: DataFrame, most: int) -> DataFrame:
    """nodes with (z, tx, ty) of each tile that their bounding box touches."""
    at = zooms(nodes, most)
    span = lambda v: F.explode(F.sequence(geometry.tile_of(F.col(v) - F.col("radius"), F.col("z")), geometry.tile_of(F.col(v) + F.col("radius"), F.col("z"))))
    return at.withColumn("tx", span("x")).where(_inside("tx")).withColumn("ty", span("y")).where(_inside("ty"))


def centred(records: DataFrame, most: int) -> DataFrame:
    """records (rounded) with the one tile that holds their centre at each zoom where they are large enough to see."""
    seen = F.col("radius") * F.lit(float(TILE_PX)) * F.pow(F.lit(2.0), F.col("z")) / WORLD >= LEAST_PX
    at = zooms(records, most).where(seen)
    return at.withColumns({"tx": geometry.tile_of(F.col("x"), F.col("z")), "ty": geometry.tile_of(F.col("y"), F.col("z"))}).where(_inside("tx", "ty"))


def raster_zoom(nodes: DataFrame, q: float = 0.001) -> DataFrame:
    """One row (q_radius, max_zoom): the radius at the nearest rank of that quantile, and the zoom at which it shows well."""
    n = nodes.count()
    spot = round(q * (n - 1)) if n else 0
    held = nodes.orderBy("radius").limit(spot + 1).agg(F.max("radius").alias("q_radius"))  # the smallest spot + 1
    return held.select("q_radius", _zoom(F.lit(ROUGH_PX) / F.col("q_radius")).alias("max_zoom"))


def _zoom(scale: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.log2(scale * (WORLD / TILE_PX))).cast("int"))


def meta_zoom(nodes: DataFrame) -> DataFrame:
    """One row (r_min, max_zoom): from this zoom on every node has its record, so none is made beyond."""
    raster = raster_zoom(nodes).select(F.col("max_zoom").alias("_raster"))
    low = nodes.agg(F.min("radius").alias("r_min"))
    return low.crossJoin(raster).select("r_min", F.least(_zoom(F.lit(LEAST_PX) / F.col("r_min")), F.col("_raster")).alias("max_zoom"))


def _neighbours(rows, keys: Sequence[str]) -> list:
    return [[n[k] for k in keys] for n in ([] if rows is None else rows)]


def _entry(rec, keys: Sequence[str]) -> dict:
    """The record under its short names, in the order that readers expect."""
    plain = {k: rec["radius" if k == "r" else k] for k in "id t x y r cl pr no ni".split()}
    counts = {k: _neighbours(rec[k], ("ncl", "count")) for k in ("ob", "ib")}
    return plain | counts | {"out": _neighbours(rec["out"], keys), "in": _neighbours(rec["inn"], keys)}


def pack_json(value) -> bytes:
    """Compact JSON, gzipped; the same bytes for the same value."""
    return gzip.compress(json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=lambda v: v.item()).encode(), 6, mtime=0)


#: What tiles and pages say of a neighbour.
PLACE, PAGE = ("nx ny nr ncl".split(), "nid nt nx ny nr ncl".split())
RECORD = tuple("id t x y radius cl pr no ni ob ib out inn".split())


def encode_tiles(records: DataFrame, most: int) -> DataFrame:
    """(z, x, y, tile_id, data): the records of a tile, by id, with neighbours as [x, y, r, cluster]."""
    held = centred(records, most).groupBy("z", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.sort_array(F.collect_list(F.struct(*RECORD))).alias("recs"))
    held = held.withColumn("tile_id", geometry.tile_id())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [pack_json([_entry(r, PLACE) for r in recs]) for recs in f["recs"]]
            yield f[["z", "x", "y", "tile_id"]].assign(data=data)

    return held.select("z", "x", "y", "tile_id", "recs").mapInPandas(run, "z int, x int, y int, tile_id bigint, data binary")


def page_slots(records: DataFrame) -> DataFrame:
    """(id, z, tile_id): the least zoom whose square grid holds every id, and each id's slot. It is sized by the largest id,
    not by the number of pages, so that gaps in the ids push none out of the grid."""
    top = records.agg(F.greatest(F.max("id") + 1, F.lit(1)).alias("n"))
    z = F.greatest(F.lit(1), F.ceil(F.log2("n") / 2).cast("int"))
    return records.select("id").crossJoin(top.select(z.alias("z"))).select("id", "z", F.expr("((1L << (2 * z)) - 1) div 3 + id").alias("tile_id"))


def encode_pages(records: DataFrame) -> DataFrame:
    """(z, x, y, tile_id, data): one page a slot, neighbours as [id, title, x, y, r, cluster]."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = [geometry.hilbert_tile(int(t)) for t in f["tile_id"]]
            data = [pack_json(_entry(r, PAGE)) for r in f.to_dict("records")]
            yield pd.DataFrame({"z": [a[0] for a in at], "x": [a[1] for a in at], "y": [a[2] for a in at], "tile_id": f["tile_id"], "data": data})

    return records.join(page_slots(records), "id").select(*RECORD, "tile_id").mapInPandas(run, "z int, x int, y int, tile_id bigint, data binary")


def _line(e: dict) -> str:
    """A record of a tile or a page as a line that other engines can write too; numbers with decimals are in hundredths."""
    flat = lambda n: " ".join(str(round(v * 100)) if isinstance(v, float) else str(v) for v in n)
    return "|".join([*(flat([e[k]]) for k in "id t x y r cl pr no ni".split()), *(",".join(flat(n) for n in e[k]) for k in ("ob", "ib", "out", "in"))])


def decode(encoded: DataFrame) -> DataFrame:
    """(z, x, y, tile_id, lines) of encoded tiles or pages: their records, one a line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = [json.loads(gzip.decompress(d)) for d in f["data"]]
            yield f[["z", "x", "y", "tile_id"]].assign(lines=["\n".join(_line(e) for e in (h if isinstance(h, list) else [h])) for h in held])

    return encoded.select("z", "x", "y", "tile_id", "data").mapInPandas(run, "z int, x int, y int, tile_id bigint, lines string")


def png(rgba: np.ndarray) -> bytes:
    """A lossless picture of straight-alpha bytes."""
    h, w, _ = rgba.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def draw(circles: pd.DataFrame, z: int, tx: int, ty: int, size: int = TILE_PX, samples: int = SAMPLES, band: int = 64) -> np.ndarray:
    """A tile's circles (x, y, radius, r, g, b) as size x size straight-alpha bytes. Coverage is the signed distance to the
    circle in the finer grid; circles of one colour are one shape; colours lie over each other in ascending order. Drawn
    in bands of rows, so that the finer grid is never held whole."""
    unit = size * samples * 2**z / WORLD
    left, top = tx * WORLD / 2**z - WORLD / 2, ty * WORLD / 2**z - WORLD / 2
    colours = [(np.append(np.array(c, np.float32) / 255, np.float32(1)), (g["x"].to_numpy() - left) * unit, (g["y"].to_numpy() - top) * unit, g["radius"].to_numpy() * unit) for c, g in circles.groupby(["r", "g", "b"])]
    out = np.zeros((size, size, 4), np.uint8)
    wide = size * samples
    for row in range(0, size, band):
        high = min(band, size - row)
        low, tall = row * samples, high * samples
        canvas = np.zeros((tall, wide, 4), np.float32)
        for ink, xs, ys, rs in colours:
            cover = np.zeros((tall, wide), np.float32)
            for i in np.flatnonzero((ys + rs + 1 > low) & (ys - rs - 1 < low + tall)):
                cx, cy, cr = xs[i], ys[i] - low, rs[i]
                x0, x1 = max(0, math.floor(cx - cr - 1)), min(wide, math.ceil(cx + cr + 1))
                y0, y1 = max(0, math.floor(cy - cr - 1)), min(tall, math.ceil(cy + cr + 1))
                if x0 < x1 and y0 < y1:
                    d = np.hypot(np.arange(x0, x1) + 0.5 - cx, (np.arange(y0, y1) + 0.5 - cy)[:, None])
                    np.maximum(cover[y0:y1, x0:x1], np.clip(cr - d + 0.5, 0, 1), out=cover[y0:y1, x0:x1])
            if cover.any():
                canvas *= 1 - cover[..., None]
                canvas += cover[..., None] * ink
        small = canvas.reshape(high, samples, size, samples, 4).mean(axis=(1, 3))
        alpha = small[..., 3:]
        straight = np.divide(small[..., :3], alpha, out=np.zeros_like(small[..., :3]), where=alpha > 0)
        out[row : row + high] = np.rint(np.clip(np.concatenate([straight, alpha], axis=2), 0, 1) * 255)
    return out


#: A tile is drawn in SPLIT x SPLIT blocks, a power of two.
SPLIT = 8


def _blocks(nodes: DataFrame, most: int, size: int, samples: int, split: int) -> DataFrame:
    """nodes with (z, bx, by) of each block that they may colour, in the tiles that their bounding boxes touch. A block is a
    tile some zooms deeper; half a sample's margin keeps the edges of circles the same as in a tile drawn whole."""
    k = split.bit_length() - 1
    at, z = zooms(nodes, most), F.col("z")

    def span(v: str) -> Column:
        low, high = (geometry.tile_of(F.col(v) + s * F.col("radius"), z) for s in (-1, 1))
        pad = F.lit(float(WORLD / size / samples)) / F.pow(F.lit(2.0), z)
        near, far = (geometry.tile_of(F.col(v) + s * (F.col("radius") + pad), z + k) for s in (-1, 1))
        side = F.expr("1 << z")
        first = F.greatest(near, F.greatest(low, F.lit(0)) * split)
        last = F.least(far, (F.least(high, side - 1) + 1) * split - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    return at.withColumn("bx", span("x")).withColumn("by", span("y"))


def raster_tiles(nodes: DataFrame, most: int, size: int = TILE_PX, samples: int = SAMPLES, split: int = SPLIT) -> DataFrame:
    """(z, x, y, tile_id, data): a PNG of each tile that some node touches, coloured by cluster. Blocks of tiles are drawn by
    themselves, so that no task draws all nodes of a low zoom, and then put together; every pixel is as if drawn whole."""
    held = _blocks(nodes.select("x", "y", "radius", *geometry.palette(F.col("partition"))), most, size, samples, split)
    part, k = size // split, split.bit_length() - 1

    def render(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        z, bx, by = (int(v) for v in key)
        return pd.DataFrame({"z": [z], "x": [bx // split], "y": [by // split], "bx": [bx % split], "by": [by % split], "pixels": [zlib.compress(draw(f, z + k, bx, by, part, samples).tobytes(), 1)]})

    def join(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        z, x, y = (int(v) for v in key)
        whole = np.zeros((size, size, 4), np.uint8)
        for bx, by, p in zip(f["bx"], f["by"], f["pixels"]):
            whole[by * part : (by + 1) * part, bx * part : (bx + 1) * part] = np.frombuffer(zlib.decompress(p), np.uint8).reshape(part, part, 4)
        return pd.DataFrame({"z": [z], "x": [x], "y": [y], "tile_id": [geometry.hilbert(z, x, y)], "data": [png(whole)]})

    drawn = held.groupBy("z", "bx", "by").applyInPandas(render, "z int, x int, y int, bx int, by int, pixels binary")
    return drawn.groupBy("z", "x", "y").applyInPandas(join, "z int, x int, y int, tile_id bigint, data binary")
