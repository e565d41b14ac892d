"""Tile archives by the public PMTiles specification, version 3: a header of 127 bytes, a root directory of at most 16 KB
with it, JSON metadata, leaf directories, then the tiles in order of their ids. Archives are named by a path or a URI that
all machines reach; they are read by ranges."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcweave import storage
from arcweave.functions import geometry

HEADER = struct.Struct("<7sB QQQQQQQQ QQQ BBBBBB iiii B ii")
ROOT_BYTES = 16384 - HEADER.size
UNKNOWN, MVT, PNG, JPEG, WEBP = 0, 1, 2, 3, 4
NONE, GZIP = 1, 2
CONTENT = {MVT: "application/x-protobuf", PNG: "image/png", JPEG: "image/jpeg", WEBP: "image/webp"}


class Head(NamedTuple):
    magic: bytes
    version: int
    root_at: int
    root_size: int
    meta_at: int
    meta_size: int
    leaf_at: int
    leaf_size: int
    data_at: int
    data_size: int
    addressed: int
    entries: int
    contents: int
    clustered: int
    internal: int
    compression: int
    kind: int
    min_zoom: int
    max_zoom: int
    west: int
    south: int
    east: int
    north: int
    zoom: int
    lon: int
    lat: int


class Entry(NamedTuple):
    tile: int
    offset: int
    size: int
    run: int


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def pack_directory(entries: list[Entry]) -> bytes:
    out = bytearray(_varint(len(entries)))
    last = 0
    for e in entries:
        out += _varint(e.tile - last)
        last = e.tile
    for e in entries:
        out += _varint(e.run)
    for e in entries:
        out += _varint(e.size)
    for i, e in enumerate(entries):
        follows = i and e.offset == entries[i - 1].offset + entries[i - 1].size
        out += _varint(0 if follows else e.offset + 1)
    return gzip.compress(bytes(out), 6, mtime=0)


def unpack_directory(data: bytes) -> list[Entry]:
    raw, at = gzip.decompress(data), 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    count, tiles, last = number(), [], 0
    for _ in range(count):
        last += number()
        tiles.append(last)
    runs = [number() for _ in range(count)]
    sizes = [number() for _ in range(count)]
    out: list[Entry] = []
    for i in range(count):
        n = number()
        out.append(Entry(tiles[i], out[-1].offset + out[-1].size if n == 0 else n - 1, sizes[i], runs[i]))
    return out


def _directories(entries: list[Entry]) -> tuple[bytes, bytes]:
    """(root, leaves): one level of leaves if the entries don't fit the root, larger ones until it fits."""
    root = pack_directory(entries)
    size = 4096
    leaves: list[bytes] = []
    while len(root) > ROOT_BYTES:
        leaves, heads, at = [], [], 0
        for i in range(0, len(entries), size):
            leaves.append(pack_directory(entries[i : i + size]))
            heads.append(Entry(entries[i].tile, at, len(leaves[-1]), 0))
            at += len(leaves[-1])
        root = pack_directory(heads)
        size *= 2
    return root, b"".join(leaves)


def write(tiles: DataFrame, path: str, kind: int = UNKNOWN, compression: int = NONE, max_zoom: int | None = None, metadata: dict | None = None) -> Head:
    """Write (z, x, y, tile_id, data) to one archive. Range partitions sorted by tile id come one after the other; equal
    tiles that follow each other are stored once."""
    if max_zoom is None:
        max_zoom = tiles.agg({"z": "max"}).first()[0] or 0
    entries: list[Entry] = []
    seen: dict[bytes, tuple[int, int]] = {}
    addressed = at = 0
    system, name = storage.filesystem(path)
    body = f"{name}.tiles"
    try:
        with system.open_output_stream(body) as f:
            for row in tiles.select("tile_id", "data").repartitionByRange("tile_id").sortWithinPartitions("tile_id").toLocalIterator(prefetchPartitions=True):
                data = bytes(row["data"])
                addressed += 1
                mark = hashlib.blake2b(data, digest_size=16).digest()
                if mark not in seen:
                    seen[mark] = (at, len(data))
                    f.write(data)
                    at += len(data)
                where = seen[mark]
                if entries and (entries[-1].offset, entries[-1].size) == where and entries[-1].tile + entries[-1].run == row["tile_id"]:
                    entries[-1] = entries[-1]._replace(run=entries[-1].run + 1)
                else:
                    entries.append(Entry(row["tile_id"], *where, 1))
        root, leaves = _directories(entries)
        meta = gzip.compress(json.dumps(metadata or {}).encode(), 6, mtime=0)
        meta_at = HEADER.size + len(root)
        leaf_at = meta_at + len(meta)
        data_at = leaf_at + len(leaves)
        head = Head(b"PMTiles", 3, HEADER.size, len(root), meta_at, len(meta), leaf_at, len(leaves), data_at, at, addressed, len(entries), len(seen), 1, GZIP, compression, kind, 0, max_zoom, -1_800_000_000, -850_000_000, 1_800_000_000, 850_000_000, 0, 0, 0)
        with system.open_output_stream(name) as f:
            for part in (HEADER.pack(*head), root, meta, leaves):
                f.write(part)
            with system.open_input_stream(body) as g:
                while block := g.read(1 << 20):
                    f.write(block)
        return head
    finally:
        if system.get_file_info(body).is_file:
            system.delete_file(body)


def read_header(path: str) -> Head:
    raw = _range(path, 0, HEADER.size)
    if len(raw) < HEADER.size or raw[:7] != b"PMTiles":
        raise ValueError("not a tile archive")
    head = Head(*HEADER.unpack(raw))
    if head.version != 3:
        raise ValueError(f"version {head.version} of the archive format, not 3")
    return head


def _range(path: str, at: int, size: int) -> bytes:
    system, name = storage.filesystem(path)
    with system.open_input_file(name) as f:
        return f.read_at(min(size, max(0, f.size() - at)), at)


class Changed(Exception):
    """The archive isn't the one that a reader has begun to read."""


def version(path: str) -> str:
    """What tells one state of an archive from another: its size and time of change."""
    system, name = storage.filesystem(path)
    info = system.get_file_info(name)
    return f"{info.size}-{info.mtime_ns}"


def lookup(path: str, z: int, x: int, y: int, expect: str | None = None) -> bytes | None:
    """One tile by its place, through the directories alone; None where there is none. With `expect`, a version(), an archive
    that was replaced since then is an error, so that no directory of one is used with the tiles of another."""
    if expect is not None and version(path) != expect:
        raise Changed(path)
    head, tile = read_header(path), geometry.hilbert(z, x, y)
    at, size = head.root_at, head.root_size
    for _ in range(4):
        found = None
        for e in unpack_directory(_range(path, at, size)):
            if e.tile > tile:
                break
            found = e
        if found is None:
            return None
        if found.run:
            return _range(path, head.data_at + found.offset, found.size) if tile < found.tile + found.run else None
        at, size = head.leaf_at + found.offset, found.size
    return None


class Leaf(InputPartition):
    def __init__(self, at: int, size: int) -> None:
        self.at, self.size = at, size


class PmtilesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Leaf]:
        head = read_header(self.path)
        root = unpack_directory(_range(self.path, head.root_at, head.root_size))
        leaves = [Leaf(head.leaf_at + e.offset, e.size) for e in root if not e.run]
        return leaves + ([Leaf(head.root_at, head.root_size)] if any(e.run for e in root) else [])

    def read(self, part: Leaf) -> Iterator[pa.RecordBatch]:
        head = read_header(self.path)
        names = ["z", "x", "y", "tile_id", "data"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        rows = []
        for e in unpack_directory(_range(self.path, part.at, part.size)):
            data = _range(self.path, head.data_at + e.offset, e.size) if e.run else b""
            rows += [(*geometry.hilbert_tile(t), t, data) for t in range(e.tile, e.tile + e.run)]
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class PmtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "z int, x int, y int, tile_id bigint, data binary"

    def reader(self, schema) -> PmtilesReader:
        return PmtilesReader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, tile_id, data) of an archive; a task reads one leaf directory and its tiles."""
    spark.dataSource.register(PmtilesSource)
    return spark.read.format("pmtiles").option("path", path).load()


def tilejson(path: str, url: str) -> dict:
    """What a map client asks for first."""
    h = read_header(path)
    return {
        "tilejson": "3.0.0", "scheme": "xyz", "tiles": [url], "minzoom": h.min_zoom, "maxzoom": h.max_zoom,
        "bounds": [h.west / 1e7, h.south / 1e7, h.east / 1e7, h.north / 1e7], "center": [h.lon / 1e7, h.lat / 1e7, h.zoom],
    }
