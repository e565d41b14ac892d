"""World and tile coordinates, colours and the Hilbert order, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD = 1 << 16
TILE_PX = 1024
GOLDEN = 0.618033988749895


def cell(v: Column, width: Column | float) -> Column:
    """Index of the cell of that width, also for negative values."""
    return F.floor(v / width).cast("int")


def tile_width(z: Column) -> Column:
    return F.lit(float(WORLD)) / F.pow(F.lit(2.0), z)


def tile_of(v: Column, z: Column) -> Column:
    """The tile index of a world coordinate; the world's centre is 0."""
    return cell(v + F.lit(WORLD / 2), tile_width(z))


def half_even(v: Column, digits: int = 2) -> Column:
    return F.bround(v.cast("double"), digits)


def max_zoom(radius: float, pixels: float) -> int:
    """The least zoom, 1 at least, at which a radius shows as that many pixels."""
    return max(1, math.ceil(math.log2(pixels / radius * WORLD / TILE_PX)))


def palette(partition: Column) -> list[Column]:
    """r, g, b of a cluster: hues at golden-ratio steps, saturation 0.9, value 1, each cut to a byte."""
    h = (partition * F.lit(GOLDEN)) % F.lit(1.0) * 6
    i, f = F.floor(h), h - F.floor(h)
    p, q, t = F.lit(1 - 0.9), 1 - F.lit(0.9) * f, 1 - F.lit(0.9) * (1 - f)
    one = F.lit(1.0)
    sides = {"r": (one, q, p, p, t, one), "g": (t, one, one, q, p, p), "b": (p, p, t, one, one, q)}
    out = []
    for name, six in sides.items():
        v = six[5]
        for k in range(4, -1, -1):
            v = F.when(i % 6 == k, six[k]).otherwise(v)
        out.append(F.floor(v * 255).cast("smallint").alias(name))
    return out


def tile_id(z: str = "z", x: str = "x", y: str = "y") -> Column:
    """Tiles of lower zooms, then the Hilbert index within the zoom."""
    walk = f"""
    aggregate(sequence(1, {z}), named_struct('d', 0L, 'x', cast({x} AS BIGINT), 'y', cast({y} AS BIGINT)),
      (a, k) -> named_struct(
        'd', a.d + (1L << (2 * ({z} - k))) * ((3 * ((a.x >> ({z} - k)) & 1)) ^ ((a.y >> ({z} - k)) & 1)),
        'x', CASE WHEN ((a.y >> ({z} - k)) & 1) = 0 THEN CASE WHEN ((a.x >> ({z} - k)) & 1) = 1 THEN (1L << ({z} - k)) - 1 - (a.y & ((1L << ({z} - k)) - 1)) ELSE a.y & ((1L << ({z} - k)) - 1) END ELSE a.x & ((1L << ({z} - k)) - 1) END,
        'y', CASE WHEN ((a.y >> ({z} - k)) & 1) = 0 THEN CASE WHEN ((a.x >> ({z} - k)) & 1) = 1 THEN (1L << ({z} - k)) - 1 - (a.x & ((1L << ({z} - k)) - 1)) ELSE a.x & ((1L << ({z} - k)) - 1) END ELSE a.y & ((1L << ({z} - k)) - 1) END),
      a -> a.d)"""
    return F.expr(f"((1L << (2 * {z})) - 1) div 3 + CASE WHEN {z} = 0 THEN 0L ELSE {walk} END")


def hilbert(z: int, x: int, y: int) -> int:
    """tile_id for single tiles, as the archive's readers and writers need it."""
    d = 0
    for k in range(z - 1, -1, -1):
        side = 1 << k
        bx, by = x >> k & 1, y >> k & 1
        d += side * side * (3 * bx ^ by)
        x, y = x & side - 1, y & side - 1
        if not by:
            if bx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return ((1 << 2 * z) - 1) // 3 + d


def hilbert_tile(tile: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile id."""
    z = 0
    while ((1 << 2 * (z + 1)) - 1) // 3 <= tile:
        z += 1
    d, x, y = tile - ((1 << 2 * z) - 1) // 3, 0, 0
    for k in range(z):
        side = 1 << k
        bx = d >> 2 * k + 1 & 1
        by = (d >> 2 * k ^ bx) & 1
        if not by:
            if bx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * bx, y + side * by
    return z, x, y
