from pathlib import Path

import numpy as np
import pytest

from arcweave import storage
from arcweave.operators import community, extract, graph, layout, overlap, records
from arcweave.operators.layout import Pass

EDGES = "src bigint, dst bigint"


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(3, 5), (4, 3), (0, 4), (2, 3), (1, 2), (0, 1)], EDGES)


@pytest.mark.parametrize(("source", "target", "want"), [(0, 3, [0, 4, 3]), (0, 5, [0, 4, 3, 5]), (0, 2, [0, 1, 2]), (3, 3, [3]), (5, 0, []), (0, 99, [])])
def test_shortest_path(six, source, target, want):
    assert graph.shortest_path(six, source, target) == want


def test_long_path_releases_its_tables(spark):
    import time

    held = len([p for p in Path(storage.shared_dir(spark).removeprefix("file:")).iterdir()])
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, 1000 + i) for i in range(60)], EDGES)
    began = time.monotonic()
    assert graph.shortest_path(edges, 0, 60) == list(range(61))
    assert time.monotonic() - began < 60
    assert len([p for p in Path(storage.shared_dir(spark).removeprefix("file:")).iterdir()]) == held
    assert graph.levels(edges, 40).agg({"level": "max"}).first()[0] == 20


@pytest.mark.parametrize(("few", "walk"), [(0, 0), (2, 0), (500, 100_000)])
def test_paths_are_the_same_by_joins_and_by_filters(spark, monkeypatch, few, walk):
    """Against a breadth-first search in memory, on a graph with wide levels."""
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "WALK", walk)
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 120, (260, 2)) if a != b})
    near = graph.index(spark.createDataFrame(pairs, EDGES))
    for source, target in ((0, 77), (5, 100), (33, 2)):
        far, front = {source: 0}, [source]
        while front:
            front = [b for a in front for x, b in pairs if x == a and b not in far and not far.update({b: far[a] + 1})]
        got = graph.shortest_path(near, source, target)
        assert len(got) == (far[target] + 1 if target in far else 0) and all(p in set(pairs) for p in zip(got, got[1:]))


def test_path_has_stubs_and_counts_nodes(spark, six):
    docs = spark.createDataFrame([(0, "zero", 1.0, 2.0, 3.0, 4)], "id bigint, t string, x double, y double, r double, cl bigint")
    row = graph.path(six, docs, 0, 3).first()
    assert row["found"] and row["length"] == 3 and [(h["id"], h["t"], h["r"]) for h in row["path"]] == [(0, "zero", 3.0), (4, "", 0.0), (3, "", 0.0)]
    none = graph.path(six, docs, 5, 0).first()
    assert not none["found"] and none["length"] == 0 and none["path"] == []


def test_levels(six):
    assert {r.id: r.level for r in graph.levels(six, 0).collect()} == {0: 0, 1: 1, 4: 1, 2: 2, 3: 2, 5: 3}


def test_pagerank_converges(six):
    rank = {r.id: r.pagerank for r in graph.pagerank(six).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == 5
    again = {i: 0.15 / 6 + 0.85 * (rank[5] / 6 + sum(rank[s] / n for s, d, n in ((0, 1, 2), (0, 4, 2), (1, 2, 1), (2, 3, 1), (4, 3, 1), (3, 5, 1)) if d == i)) for i in range(6)}
    assert sum(abs(again[i] - rank[i]) for i in rank) < 2e-6


def test_offsets_have_gaps_and_an_end(spark):
    e = spark.createDataFrame([(0, 9000), (0, 3), (5000, 0)], EDGES)
    got = [r["first"] for r in graph.offsets(e, "src").orderBy("id").collect()]
    assert len(got) == 9002 and got[:2] == [0, 2] and got[5000:5002] == [2, 3] and got[-1] == 3


def two_cliques(spark):
    e = [(a, b) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(5, 10)]
    return spark.createDataFrame(e, "a bigint, b bigint")


def test_leiden_parts_cliques(spark):
    pairs = two_cliques(spark)
    labels = community.leiden(pairs)
    got = {r.id: r.label for r in labels.collect()}
    assert {got[i] for i in range(6)} == {0} and {got[i] for i in range(10, 16)} == {10}
    q = community.modularity(pairs, labels).first()[0]
    one = community.modularity(pairs, labels.selectExpr("id", "0 AS label")).first()[0]
    assert q > 0.4 and abs(one) < 1e-12
    assert {r.id: r.label for r in community.leiden(pairs).collect()} == got


@pytest.mark.parametrize("small", [0, 1000])
def test_layout_brings_neighbours_together(spark, small):
    """By distributed rounds and by one task."""
    pairs = two_cliques(spark)
    radius = spark.createDataFrame([(i, 50.0) for i in (*range(6), *range(10, 16))], "id bigint, radius double")
    at = {r.id: (r.x, r.y) for r in layout.layout(pairs, radius, (Pass(12, 0.5, False, 5.0), Pass(2, 0.05, True, 100.0)), small=small).collect()}
    far = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5
    inside = [far(a, b) for a in range(6) for b in range(a)]
    across = [far(a, b) for a in range(6) for b in range(10, 16)]
    assert sum(inside) / len(inside) < sum(across) / len(across) and max(abs(v) for p in at.values() for v in p) == pytest.approx(32768)


def test_layout_by_one_task_is_that_of_the_rounds(spark):
    """Three rounds of a graph whose cells hold one node each, where both are exact."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a bigint, b bigint")
    radius = spark.createDataFrame([(i, 50.0) for i in range(8)], "id bigint, radius double")
    one, two = ({r.id: (r.x, r.y) for r in layout.layout(pairs, radius, (Pass(3, 0.5, False, 5.0),), grid=256, small=small, still=0.0).collect()} for small in (1000, 0))
    assert one.keys() == two.keys() and all(abs(p - q) < 1 for i in one for p, q in zip(one[i], two[i]))


def test_layout_ends_when_nothing_moves(spark):
    pairs = two_cliques(spark)
    radius = spark.createDataFrame([(i, 50.0) for i in (*range(6), *range(10, 16))], "id bigint, radius double")
    once = layout.layout(pairs, radius, (Pass(1, 0.5, False, 5.0),), small=0).collect()
    assert sorted(once) == sorted(layout.layout(pairs, radius, (Pass(9, 0.5, False, 5.0),), small=0, still=9.0).collect())
    nodes = layout.layout(pairs, radius).collect()  # the whole default passes
    assert len(nodes) == 12 and all(np.isfinite([r.x, r.y]).all() for r in nodes)


def test_leiden_is_near_the_best(spark):
    """Modularity against the best of many runs of plain local moves, one node at a time, in memory."""
    rng = np.random.default_rng(3)
    block = np.repeat(np.arange(4), 10)
    e = [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.5 if block[i] == block[j] else 0.04)]
    pairs = spark.createDataFrame(e, "a bigint, b bigint")
    adj = np.zeros((40, 40))
    for i, j in e:
        adj[i, j] = adj[j, i] = 1
    k, m2 = adj.sum(1), adj.sum()
    quality = lambda lab: ((adj - np.outer(k, k) / m2) * (lab[:, None] == lab)).sum() / m2
    best = quality(block)
    for _ in range(20):
        lab, moved = np.arange(40), True
        while moved:
            moved = False
            for i in rng.permutation(40):
                gains = {c: quality(np.where(np.arange(40) == i, c, lab)) for c in set(lab[adj[i] > 0])}
                c = max(gains, key=gains.get)
                if gains[c] > quality(lab) + 1e-12:
                    lab[i], moved = c, True
        best = max(best, quality(lab))
    got = community.modularity(pairs, community.leiden(pairs)).first()[0]
    assert got >= 0.97 * best


def test_relax_ends_without_overlaps(spark):
    nodes = spark.createDataFrame([(i, float(i % 5) * 8, float(i // 5) * 8, 5.0 + i % 3) for i in range(25)] + [(25, 0.0, 0.0, 5.0)], "id bigint, x double, y double, radius double")
    assert overlap.overlaps(nodes).count() > 0
    done = overlap.relax(nodes, 40)
    assert overlap.overlaps(done).count() == 0 and overlap.rounded_check(done).first()["overlaps"] == 0
    assert sorted(overlap.relax(done).collect()) == sorted(done.collect())


def test_dense_ids_are_positions(spark):
    df = spark.createDataFrame([(f"t{(i * 37) % 101:03d}",) for i in range(101)], "title string")
    assert [(r.id, r.title) for r in extract.dense_ids(df, "title").orderBy("id").collect()] == [(i, f"t{i:03d}") for i in range(101)]
    assert extract.dense_ids(df.limit(0), "title").count() == 0


def test_records_rank_cap_and_nulls(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", i / 10, i % 2, 1.005 * i, 0.0, 1.0) for i in range(5)], "id bigint, title string, pagerank double, partition bigint, x double, y double, radius double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2)], EDGES)
    got = {r.id: r for r in records.records(nodes, edges, cap=2).collect()}
    assert [n.nid for n in got[0].out] == [3, 2] and got[0].no == 3 and [(c.ncl, c["count"]) for c in got[0].ob] == [(1, 2), (0, 1)]
    assert got[4].out is None and got[4].no == 0 == got[4].ni and got[4].pr == 1 and got[0].pr == 5
    best = {r.id: (r["count"], r.name) for r in records.clusters(nodes).collect()}
    assert best == {0: (3, "n4"), 1: (2, "n3")}
