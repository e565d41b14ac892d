import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arcweave import schemas, stages
from arcweave.functions import geometry
from arcweave.operators import records, tiles
from arcweave.plans import adapters
from arcweave.sinks import files
from arcweave.sources import csr, dump, pmtiles
from tests.conftest import SMALL


def curve(z, x, y):
    """The Hilbert index by the textbook loop."""
    n, d, s = 1 << z, 0, (1 << z) // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s //= 2
    return (4**z - 1) // 3 + d


def test_tile_ids(spark):
    every = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    df = spark.createDataFrame(every, "z int, x int, y int")
    got = {(r.z, r.x, r.y): r.i for r in df.select("z", "x", "y", geometry.tile_id().alias("i")).collect()}
    for t in every:
        assert got[t] == curve(*t) == geometry.hilbert(*t) and geometry.hilbert_tile(got[t]) == t


def test_csr_comes_back(spark, tmp_path):
    edges = spark.createDataFrame([(0, 7), (0, 2), (3, 0), (7, 3), (3, 7)], schemas.EDGES)
    path = str(tmp_path / "g.csr")
    assert csr.write(edges, path) == (8, 5)
    raw = np.frombuffer(open(path, "rb").read()[4:], "<u4")
    assert raw[:3].tolist() == [1, 8, 5] and raw[3:12].tolist() == [0, 2, 2, 2, 4, 4, 4, 4, 5] and raw[12:17].tolist() == [2, 7, 0, 7, 3]
    for back in (False, True):
        assert sorted(map(tuple, csr.read(spark, path, back).collect())) == sorted(map(tuple, edges.collect()))
    (tmp_path / "bad").write_bytes(b"nope" + bytes(40))
    with pytest.raises(ValueError, match="graph file"):
        csr.header(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="32-bit"):
        csr.write(edges, path, n=5)


def test_archive_comes_back(spark, tmp_path):
    rows = [(z, x, y, geometry.hilbert(z, x, y), f"{z}-{x}-{y // 2}".encode()) for z in range(6) for x in range(1 << z) for y in range(1 << z) if (x + y) % 3]
    df = spark.createDataFrame(rows, schemas.TILE)
    path = str(tmp_path / "t.pmtiles")
    head = pmtiles.write(df, path, pmtiles.PNG)
    assert head.addressed == len(rows) > head.contents and head.max_zoom == 5
    got = {tuple(r)[:4]: bytes(r.data) for r in pmtiles.read(spark, path).collect()}
    assert got == {r[:4]: r[4] for r in rows}
    assert pmtiles.lookup(path, 5, 3, 1) == b"5-3-0" and pmtiles.lookup(path, 5, 3, 3) is None
    assert stages.serve_tile(path, 5, 3, 1) == (200, "image/png", b"5-3-0") and stages.serve_tile(path, 5, 3, 3)[0] == 204 and stages.serve_tile(path, 6, 0, 0)[0] == 404
    assert pmtiles.tilejson(path, "/t/{z}/{x}/{y}.png")["maxzoom"] == 5


def test_large_directories_get_leaves(tmp_path):
    entries = [pmtiles.Entry(i * 3, i * i * 7, i % 1000 + 1, 1) for i in range(60_000)]
    root, leaves = pmtiles._directories(entries)
    assert len(root) <= pmtiles.ROOT_BYTES and leaves
    heads = pmtiles.unpack_directory(root)
    assert [e for h in heads for e in pmtiles.unpack_directory(leaves[h.offset : h.offset + h.size])] == entries


def test_ndjson_and_meta(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é", 1.5, 2.0, 3.0, 4, 0.1, None), (2, None, 1.0, 2.0, 3.0, 4, 0.1, ["b"])], schemas.SEARCH_DOC)
    files.ndjson(docs, str(tmp_path / "d"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("*.json")))
    assert '{"id":1,"t":"é","x":1.5' in text and '"a":[]' in text and '"t":null' in text
    assert sorted(r.a for r in dump.read_search_docs(spark, str(tmp_path / "d")).collect()) == [[], ["b"]]
    (tmp_path / "broken.json").write_text('{"id": 1, "t": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        dump.read_search_docs(spark, str(tmp_path / "broken.json")).collect()
    totals = spark.createDataFrame([(3, 2)], "total_pages bigint, total_links bigint")
    clusters = spark.createDataFrame([(0, 1, "ü", 1, 2, 3), (5, 2, "b", 4, 5, 6)], "id bigint, count bigint, name string, r int, g int, b int")
    files.meta_json(totals, clusters, str(tmp_path / "meta.json"))
    meta = json.loads((tmp_path / "meta.json").read_text())
    assert meta["clusters"][0] == {"id": 5, "color": [4, 5, 6], "count": 2, "name": "b"} and dump.read_meta(spark, str(tmp_path / "meta.json")).first()["total_pages"] == 3
    with pytest.raises(TypeError, match="title"):
        schemas.require(totals, schemas.NODES)


def test_pictures():
    one = pd.DataFrame({"x": [-16384.0], "y": [-16384.0], "radius": [8192.0], "r": [10], "g": [200], "b": [30]})
    img = tiles.draw(one, 0, 0, 0, size=64, band=16)
    assert img[16, 16].tolist() == [10, 200, 30, 255] and img[40, 40].tolist() == [0, 0, 0, 0]
    assert abs(img[..., 3].sum() / 255 - np.pi * 8**2) < 1 and np.array_equal(img, tiles.draw(one, 0, 0, 0, size=64, band=64))
    edge = img[(img[..., 3] > 0) & (img[..., 3] < 255)]
    assert len(edge) and (abs(edge[:, :3].astype(int) - [10, 200, 30]) <= 1).all()
    data = tiles.png(img)
    at = data.index(b"IDAT")
    size = struct.unpack(">I", data[at - 4 : at])[0]
    assert np.array_equal(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(64, 257)[:, 1:].reshape(64, 64, 4), img)


def test_encoded_records(spark):
    nodes = adapters.spatial(spark, SMALL)
    recs = records.records(nodes, adapters.near(spark, SMALL))
    per = {}
    for r in tiles.encode_tiles(recs, 3).collect():
        got = json.loads(gzip.decompress(r.data))
        assert r.tile_id == geometry.hilbert(r.z, r.x, r.y) and list(got[0]) == "id t x y r cl pr no ni ob ib out in".split()
        per.setdefault(r.z, []).extend(e["id"] for e in got)
        assert all(len(n) == 4 for e in got for n in e["out"])
    assert all(len(v) == len(set(v)) for v in per.values()) and len(per) == 4
    pages = [(r.tile_id, json.loads(gzip.decompress(r.data))) for r in tiles.encode_pages(recs).collect()]
    low = min(t for t, _ in pages)
    assert all(t - low == p["id"] for t, p in pages) and all(len(n) == 6 for _, p in pages for n in p["out"])


def test_blocks_make_the_tile_drawn_whole(spark):
    nodes = adapters.spatial(spark, SMALL)
    flat = nodes.select("x", "y", "radius", *geometry.palette(F.col("partition")))
    got = {(r.z, r.x, r.y): bytes(r.data) for r in tiles.raster_tiles(nodes, 1, size=128, split=4).collect()}
    want = {}
    for key, f in tiles.touched(flat, 1).toPandas().groupby(["z", "tx", "ty"]):
        want[tuple(map(int, key))] = tiles.png(tiles.draw(f, *map(int, key), 128))
    assert got == want and len(got) == 5


def test_files_by_uri(spark, tmp_path):
    edges = spark.createDataFrame([(i, (7 * i + 1) % 5000) for i in range(5000)], schemas.EDGES)
    uri = (tmp_path / "g.csr").as_uri()
    assert csr.write(edges, uri, 6000) == (6000, 5000)
    assert sorted(map(tuple, csr.read(spark, uri).collect())) == sorted(map(tuple, edges.collect()))
    tile = spark.createDataFrame([(0, 0, 0, 0, b"one")], schemas.TILE)
    at = (tmp_path / "t.pmtiles").as_uri()
    pmtiles.write(tile, at, pmtiles.PNG)
    seen = pmtiles.version(at)
    assert pmtiles.lookup(at, 0, 0, 0, seen) == b"one" and not list(tmp_path.glob("*.tiles"))
    pmtiles.write(spark.createDataFrame([(0, 0, 0, 0, b"another")], schemas.TILE), at, pmtiles.PNG)
    with pytest.raises(pmtiles.Changed):
        pmtiles.lookup(at, 0, 0, 0, seen)


@pytest.mark.parametrize(("url", "want"), [("/nodes/3/1/2.png", {"name": "nodes", "z": 3, "x": 1, "y": 2, "ext": "png"}), ("/nodes.json", {"name": "nodes"}), ("/nodes/3/1.png", None), ("/", None)])
def test_urls(url, want):
    assert stages.parse_url(url) == want


def test_no_palette_differs_from_the_standard_library(spark):
    import colorsys

    got = spark.range(500).select("id", *geometry.palette(F.col("id"))).collect()
    for r in got:
        assert (r.r, r.g, r.b) == tuple(int(c * 255) for c in colorsys.hsv_to_rgb(r.id * 0.618033988749895 % 1.0, 0.9, 1.0))
