import numpy as np
import pytest

from arcweave.llm import rp_forest as R

SCHEMA = "vec_id long, embedding array<float>, label int"


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def brute(x, similar):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(u @ u.T >= similar, 1))]


def test_recall_with_upper_levels(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((900, 16))
    near = base[:300] + 0.08 * rng.standard_normal((300, 16))
    x = np.concatenate([base, near, base[:20]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    want = brute(x.astype(float), R.SIMILAR)
    for cell in (1 << 15, 128):
        got = {r.vec_id: r.group_id for r in R.near_duplicates(df, leaf=64, cell=cell).collect()}
        met = sum(got.get(a, -1) == got.get(b, -2) for a, b in want)
        assert met >= 0.9 * len(want) and len(want) > 300
        true = groups(want)
        assert all(true.get(k) is not None for k in got)  # nothing that has no near one


def test_leaves_are_bounded_also_for_equal_and_scaled_points(monkeypatch):
    rng, sizes = np.random.default_rng(5), []
    whole = R.leaf_edges
    monkeypatch.setattr(R, "leaf_edges", lambda x, similar: (sizes.append(len(x)), whole(x, similar))[1])
    v = rng.standard_normal(8)
    x = np.outer(rng.uniform(0.1, 9, 3000), v)
    for points in (x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((3000, 4)) / 2):
        a, b, _ = R.cell_edges(np.arange(3000), points.astype(np.float32), [1, 2, 3], 64, 0.05, 0.9)
        assert max(sizes) <= 64 and set(groups(zip(a.tolist(), b.tolist())).values()) == {0}


def test_scaled_copies_and_a_mean_direction(spark):
    """A hot vector in a thousand scales, and vectors that all lean to one side: recall is measured and reached."""
    rng = np.random.default_rng(6)
    mean = rng.standard_normal(24)
    mean *= 1.5 / np.linalg.norm(mean)
    base = mean + rng.standard_normal((3000, 24)) / np.sqrt(24)
    near = base[:1000] + rng.standard_normal((1000, 24)) * 0.35 / np.sqrt(24)
    x = np.concatenate([base, near, np.outer(rng.uniform(0.5, 5, 1000), base[7])]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    want = brute(x.astype(float), 0.97)
    pairs, group, recall = R.measured(df, trees=2, leaf=64, cell=512, similar=0.97, queries=1000)
    got = {r.id: r.group for r in group.collect()}
    met = sum(got.get(a, -1) == got.get(b, -2) for a, b in want) / len(want)
    assert met >= 0.9 and recall[-1] >= R.RECALL and len(want) > 10_000
    away = [(a, b) for a, b in want if a < 3000 <= b < 4000]
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in away) >= 0.9 * len(away) > 90


def test_short_recall_is_an_error(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, base * 1.0 + 0.01 * rng.standard_normal((400, 8)).astype(np.float32)]))], SCHEMA)
    monkeypatch.setattr(R, "MORE", 1)
    with pytest.raises(RuntimeError, match="recall"):
        R.near_duplicates(df, trees=1, leaf=4, spill=0.0, recall=1.0).count()


def test_leaf_edges_span_groups():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((5, 8)), 6, axis=0) + 0.02 * rng.standard_normal((30, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    a, b, s = R.leaf_edges(x, 0.9)
    assert groups(zip(a.tolist(), b.tolist())) == groups(brute(x.astype(float), 0.9)) and (s >= 0.9).all()


def test_odd_rows(spark):
    good, far = [1.0, 0.0, 0.5], [-1.0, 0.2, 0.0]
    rows = [(1, good, 0), (2, good, None), (2, good, 0), (3, [1.0, 0.01, 0.5], 0), (4, far, 0), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 0.5], 0), (9, [1.0, float("nan"), 0.5], 0), (None, good, 0), (10, [1.0, 0.0], 0), (11, [float("inf"), 0.0, 0.0], 0), (12, [2.0, 0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS node", "4 AS a", "5 AS key")
    got = {r.vec_id: (r.group_id, round(r.similarity, 3)) for r in R.near_duplicates(df).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 1.0), 12: (1, 1.0)}
    assert R.near_duplicates(df.limit(0)).count() == 0
