"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; points within SPILL of the median, in quantiles, go to
both sides, so close neighbours are seldom parted. The upper levels, down to nodes of about CELL points, are fitted one
after the other by an aggregate of quantiles over all points' projections, which moves numbers and no vectors; the cuts (a
pair for CELL points) then tell every point its cell in each tree, and vectors move once a tree. A cell is split in memory
to leaves of at most LEAF points, by rank, so that ties and equal points are divided too, and all pairs in a leaf are
compared exactly. From a leaf come verified pairs that span each of its groups, not all pairs.

Recall falls with the depth of the trees and with a mean direction that all vectors share, so it is measured: for about
QUERIES points, chosen by hash, all their neighbours are found in one pass against all points, and trees are added, TREES
at a time, until at least RECALL of those pairs are in one group.

Defined results. Null ids, null, empty and zero vectors and those with a null or a number that isn't finite take no part.
Vectors of different lengths are never similar. Copies of a vector, also scaled ones whose unit vectors are equal, are one
point, whatever their number; rows that repeat a vec_id with another vector are both compared under that id. Equal
projections are told apart by the id. The group is named by its smallest vec_id. An empty table gives an empty result.
Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import textnum, util

TREES = 8
LEAF = 256
SPILL = 0.05
CELL = 1 << 15
SIMILAR = 0.9
QUERIES = 512
RECALL = 0.95
#: Times that trees are added at most; falling short of RECALL then is an error, not a result.
MORE = 16
Cuts = dict[tuple[int, int, int], np.ndarray]  # (tree, length, level) -> low and high cut by node


def _directions(tree: int, dim: int, levels: int) -> np.ndarray:
    return np.random.default_rng([tree, dim, 1]).standard_normal((levels, dim)).astype(np.float32)


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(col), -1)


def _jitter(ids: np.ndarray, seed: int) -> np.ndarray:
    """Small numbers by id that part equal projections; those of unit vectors spread over about 1."""
    return ((textnum.mix(ids.astype(np.int64).view(textnum.U), seed) >> textnum.U(40)).astype(np.float64) / 2**24 - 0.5) * 1e-3


def leaf_edges(x: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, similarity) of at least `similar` among unit vectors that span the groups which all such pairs form."""
    s = x @ x.T
    near = s >= similar
    np.fill_diagonal(near, True)
    n = len(x)
    if near.sum() == n:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    label, a, b = np.arange(n), [], []
    while True:
        seen = np.where(near, label[None, :], n)
        who = seen.argmin(1)
        low = seen[np.arange(n), who]
        moved = np.flatnonzero(low < label)
        if not len(moved):
            break
        a.append(moved)
        b.append(who[moved])
        label = np.minimum(label, low)
    a, b = np.concatenate(a), np.concatenate(b)
    return a, b, s[a, b]


def cell_edges(ids: np.ndarray, x: np.ndarray, seed: list[int], leaf: int, spill: float, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split one cell to leaves of at most `leaf` points and compare within them."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(x))], []
    shift = _jitter(ids, seed[0])
    while todo:
        at = todo.pop()
        if (n := len(at)) > leaf:
            order = at[np.argsort(x[at] @ rng.standard_normal(x.shape[1]).astype(np.float32) + shift[at], kind="stable")]
            over = min(int(spill * n), n // 2 - 1)
            todo += [order[: n // 2 + over], order[n // 2 - over :]]
            continue
        a, b, s = leaf_edges(x[at], similar)
        out.append((ids[at[a]], ids[at[b]], s))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0))


def _points(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<float>")
    good = F.expr("size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < float('infinity')) and exists(embedding, v -> v <> 0)")
    points = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & good)
    norm = F.expr("sqrt(aggregate(embedding, 0D, (s, v) -> s + cast(v as double) * v))")
    return points.withColumn("norm", norm).select("vec_id", F.expr("transform(embedding, v -> cast(v / norm as float))").alias("v"))


def _nodes(ids: np.ndarray, x: np.ndarray, tree: int, levels: int, cuts: Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, projection at level `levels`) of points in one tree, through the cuts of the levels above."""
    dim = x.shape[1]
    p = (x @ _directions(tree, dim, levels + 1).T).astype(np.float64) + _jitter(ids, tree)[:, None]
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k in range(levels):
        low, high = cuts[tree, dim, k][node].T
        q = p[row, k]
        left, right = q <= high, ~(q < low)
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node, p[row, levels]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of the vectors of each length, some thousand at a time."""
    size = np.diff(batch.column(1).offsets.to_numpy())
    for dim in np.unique(size):
        every = np.flatnonzero(size == dim)
        for at in range(0, len(every), 4096):
            some = every[at : at + 4096]
            yield some, batch.column(0).to_numpy()[some], _matrix(batch.column(1).take(pa.array(some)))


def _fit(points: DataFrame, trees: range, levels: int, spill: float) -> Cuts:
    """The cuts of the upper levels: one pass over the points a level."""
    cuts: Cuts = {}
    for level in range(levels):

        def project(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, ids, x in _by_length(batch):
                    for t in trees:
                        _, node, p = _nodes(ids, x, t, level, shared.value)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), c, np.int32)) for c in (t, x.shape[1])] + [pa.array(node), pa.array(p)], names=["tree", "dim", "node", "p"])

        shared = points.sparkSession.sparkContext.broadcast(cuts)  # two numbers for each CELL points and tree
        rows = points.mapInArrow(project, "tree int, dim int, node long, p double")
        found = rows.groupBy("tree", "dim", "node").agg(F.percentile_approx("p", [0.5 - spill, 0.5 + spill], 10000).alias("cut")).toArrow()
        for tree, dim, node, cut in zip(*(found[c].to_pylist() for c in ("tree", "dim", "node", "cut"))):
            cuts.setdefault((tree, dim, level), np.zeros((1 << level, 2)))[node] = cut
        shared.unpersist()
    return cuts


def _forest(points: DataFrame, n: int, trees: range, leaf: int, spill: float, similar: float, cell: int) -> DataFrame:
    """(a, b, similarity): verified pairs that span the groups found by these trees."""
    levels = max(0, math.ceil(math.log2(max(1, n) / cell)))
    shared = points.sparkSession.sparkContext.broadcast(_fit(points, trees, levels, spill))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, ids, x in _by_length(batch):
                part = batch.take(pa.array(some))
                for t in trees:
                    row, node, _ = _nodes(ids, x, t, levels, shared.value)
                    held = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.full(len(row), x.shape[1], np.int32)), pa.array(np.full(len(row), t, np.int32)), pa.array(node)], names=["id", "v", "dim", "tree", "node"])

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def compare(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        a, b, s = cell_edges(ids[order], _matrix(table["v"])[order], [table["tree"][0].as_py(), table["node"][0].as_py(), 7], leaf, spill, similar)
        return pa.table([np.minimum(a, b), np.maximum(a, b), np.round(s.astype(np.float64), 6)], schema=schema)

    cells = points.mapInArrow(route, "id long, v array<float>, dim int, tree int, node long")
    found = cells.groupBy("tree", "node", "dim").applyInArrow(compare, "a long, b long, similarity double").where("a < b")
    return util.materialize(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "pairs")


def _neighbours(points: DataFrame, n: int, queries: int, similar: float) -> DataFrame:
    """(a, b): all points b that are similar to a, for about `queries` points a."""
    asked = points.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // queries))) == 0).toArrow()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in asked.to_batches():
        for _, ids, x in _by_length(batch):
            old = by.get(x.shape[1], (ids[:0], x[:0]))
            by[x.shape[1]] = (np.concatenate([old[0], ids]), np.concatenate([old[1], x]))
    shared = points.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, x in _by_length(batch):
                if x.shape[1] in shared.value:
                    who, y = shared.value[x.shape[1]]
                    i, j = np.nonzero(x @ y.T >= similar)
                    apart = ids[i] != who[j]
                    yield pa.RecordBatch.from_arrays([pa.array(who[j][apart]), pa.array(ids[i][apart])], names=["a", "b"])

    return points.mapInArrow(run, "a long, b long")


def _recall(near: DataFrame, group: DataFrame) -> float:
    """The share of those pairs that are in one group; 1 where there are none."""
    of = lambda k: group.select(F.col("id").alias(k), F.col("group").alias("g" + k))
    n, met = near.join(of("a"), "a", "left").join(of("b"), "b", "left").agg(F.count("*"), F.count_if(F.col("ga") == F.col("gb"))).first()
    return met / n if n else 1.0


def measured(embeddings: DataFrame, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, similar: float = SIMILAR, cell: int = CELL, queries: int = QUERIES, recall: float = RECALL) -> tuple[DataFrame, DataFrame, list[float]]:
    """(pairs, groups, the recall measured after each `trees` trees). pairs (a, b, similarity), a < b, are copies as (first,
    copy, 1), and verified pairs that span the groups found; groups is (id, group)."""
    whole = util.materialize(_points(embeddings).withColumn("key", F.md5(F.concat_ws(",", "v"))), "vectors")
    first = util.materialize(whole.groupBy("key").agg(F.min("vec_id").alias("id"), F.max("vec_id").alias("z"), F.first("v").alias("v")), "vectors")
    copies = whole.join(first.where("id < z").select("key", "id"), "key").where("id < vec_id").select(F.col("id").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    pairs = copies = util.materialize(copies, "pairs")
    util.release(whole)
    points, n = first.select("id", "v"), first.count()
    if not n:
        return pairs, util.components(pairs), []
    near = util.materialize(_neighbours(points, n, queries, similar), "neighbours")
    seen: list[float] = []
    while not seen or seen[-1] < recall:
        if len(seen) == MORE:
            raise RuntimeError(f"recall {seen[-1]:.3f} with {MORE * trees} trees: give more trees or spill")
        if seen:
            util.release(group)
        pairs = pairs.unionByName(_forest(points, n, range(len(seen) * trees, (len(seen) + 1) * trees), leaf, spill, similar, cell))
        group = util.components(pairs)
        seen.append(_recall(near, group))
    util.release(near)
    util.release(first)
    return pairs, group, seen


def near_duplicates(embeddings: DataFrame, **parameters) -> DataFrame:
    """(vec_id, group_id, similarity) for every member of a group of at least two; similarity is the largest one found."""
    pairs, group, _ = measured(embeddings, **parameters)
    best = pairs.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("similarity"))
    return group.join(best, "id").select(F.col("id").alias("vec_id"), F.col("group").alias("group_id"), "similarity")
