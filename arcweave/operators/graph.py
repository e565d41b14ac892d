"""Adjacency, degrees, ranks and shortest paths over edges(src, dst)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import storage

DAMPING = 0.85
TOLERANCE = 1e-6
ROUNDS = 100
#: Nodes of a frontier that a filter names, and visited nodes that the driver reads for a path, at most.
FEW = 500
WALK = 100_000
#: Edges over which one task iterates: some 60 bytes each.
HELD = 16_000_000


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, each once."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))


def offsets(edges: DataFrame, side: str, n: int | None = None) -> DataFrame:
    """(id, first): where the neighbours of each id from 0 to n - 1 (to the largest) begin, and one more row for the end. A running sum
    within blocks of ids, shifted by the totals of the blocks before, so no task sorts all ids."""
    spark = edges.sparkSession
    if n is None:
        top = edges.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
        n = 0 if top is None else top + 1
    ids = spark.range(0, n).select(F.expr("id div 4096").alias("block"), "id")
    held = ids.join(degrees(edges, side), "id", "left").select("block", "id", F.coalesce("degree", F.lit(0)).alias("n"))
    total = held.groupBy("block").agg(F.sum("n").alias("n"))
    before = total.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))  # a row per 4,096 ids
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("id")) - F.col("n")
    last = edges.agg(F.count("*").alias("first")).select(F.lit(n).cast("bigint").alias("id"), "first")
    return held.withColumn("inner", inner).join(before, "block").select("id", (F.col("base") + F.col("inner")).alias("first")).union(last)


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, out, into): sorted neighbours of every id that has some."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("into"))
    none = F.expr("cast(array() AS array<bigint>)")
    return out.join(into, "id", "full").select("id", F.coalesce("out", none).alias("out"), F.coalesce("into", none).alias("into"))


def _ranks(src: np.ndarray, dst: np.ndarray, rounds: int, tolerance: float | None, damping: float) -> dict:
    """The same in memory."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d, n = at[: len(src)], at[len(src) :], max(len(ids), 1)
    degree = np.bincount(s, minlength=len(ids))
    share, rank = 1.0 / degree[s], np.full(len(ids), 1.0 / n)
    for _ in range(rounds if len(ids) else 0):
        base = (1 - damping) / n + damping * rank[degree == 0].sum() / n
        old, rank = rank, base + damping * np.bincount(d, rank[s] * share, len(ids))
        if tolerance is not None and np.abs(rank - old).sum() < tolerance:
            break
    return {"id": ids, "pagerank": rank}


def pagerank(edges: DataFrame, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(id, pagerank) by power iteration from the uniform vector; the rank of ids without out-edges spreads evenly. Ends when
    the vector moves by less than tolerance in sum, or after `rounds`. The edges are made once. At most HELD of them are
    iterated over by one task; more carry their source's out-degree, and a round is one join and one aggregation, and its
    change and dangling rank one small aggregate."""
    edges = storage.materialize(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")), "edges")
    if edges.count() <= HELD:
        out = storage.by_one([edges], lambda t: _ranks(t["src"].to_numpy(), t["dst"].to_numpy(), rounds, tolerance, damping), "id bigint, pagerank double", "rank")
        storage.release(edges)
        return out
    deg = edges.groupBy("src").agg(F.count("*").alias("n"))
    flow = storage.materialize(edges.join(deg, "src").select("src", "dst", (F.lit(1.0) / F.col("n")).alias("share")), "flow")
    ids = storage.materialize(vertices(edges).join(deg.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left"), "ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    rank = ids.select("id", F.lit(1.0 / n).alias("rank"), "gives")
    loose = ids.where("gives is null").count() / n
    for k in range(rounds):
        base = (1 - damping) / n + damping * loose / n
        into = flow.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = rank.join(into, "id", "left").select("id", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), "gives", F.col("rank").alias("old"))
        new = storage.materialize(new, "rank")
        change, loose = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("rank"))), F.lit(0.0))).first()
        storage.release(rank)
        rank = new.select("id", "rank", "gives")
        rank._arcweave_path = new._arcweave_path
        if tolerance is not None and change < tolerance:
            break
    return rank.select("id", F.col("rank").alias("pagerank"))


def index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges sorted by source and by target, so that a filter on some nodes reads few row groups."""
    sorted_ = lambda near, far: storage.materialize(edges.select("src", "dst").repartitionByRange(near).sortWithinPartitions(near, far), "edges")
    return sorted_("src", "dst"), sorted_("dst", "src")


def levels(edges: DataFrame, source: int) -> DataFrame:
    """(id, level): steps from source to everything that it reaches. Levels are appended to one table."""
    spark = edges.sparkSession
    near = storage.materialize(edges.select("src", "dst"), "edges")
    seen = storage.Growing(spark.createDataFrame([(source, 0)], "id bigint, level int"), "level")
    k = 0
    while True:
        front = seen.read().where(F.col("level") == k)
        if front.isEmpty():
            storage.release(near)
            return seen.read()
        k += 1
        met = front.join(near, front["id"] == near["src"]).select(F.col("dst").alias("id")).distinct()
        seen.add(met.join(seen.read().select("id"), "id", "left_anti").select("id", F.lit(k).alias("level")))


def shortest_path(edges: DataFrame | tuple[DataFrame, DataFrame], source: int, target: int) -> list[int]:
    """The nodes of a shortest directed path, [] if there is none; edges may be those that index() has sorted. Both ends
    search; in each round the smaller frontier grows by a whole level, so the first meeting is a shortest one. Of several
    parents the smallest id counts, of several meeting points the smallest id. Visited nodes are appended to a table a side.
    Frontiers of at most FEW nodes become filters that the sorted edges prune by, larger ones joins; only they and the
    path's own nodes come to the driver."""
    near = edges if isinstance(edges, tuple) else index(edges)
    spark = near[0].sparkSession
    wanted = F.col("id").isin(source, target)
    there = near[0].select(F.col("src").alias("id")).where(wanted).unionByName(near[1].select(F.col("dst").alias("id")).where(wanted)).distinct().count()
    if there < len({source, target}) or source == target:
        return [source] if there and source == target else []
    start = lambda v: storage.Growing(spark.createDataFrame([(v, None, 0, None)], "id bigint, parent bigint, depth int, other int"), "seen")
    seen, front, size, depth, total = [start(source), start(target)], [[source], [target]], [1, 1], [0, 0], [1, 1]
    ends, met = (("src", "dst"), ("dst", "src")), None
    while met is None and min(size):
        s = 0 if size[0] <= size[1] else 1
        own, far = ends[s]
        old = seen[s].read()
        if front[s] is None:
            step = near[s].join(old.where(F.col("depth") == depth[s]).select(F.col("id").alias(own)), own)
        else:
            step = near[s].where(F.col(own).isin(front[s]))
        depth[s] += 1
        step = step.groupBy(F.col(far).alias("id")).agg(F.min(own).alias("parent")).join(old.select("id"), "id", "left_anti")
        step = step.join(seen[1 - s].read().select("id", F.col("depth").alias("other")), "id", "left")
        seen[s].add(step.select("id", "parent", F.lit(depth[s]).alias("depth"), "other"))
        new = seen[s].read().where(F.col("depth") == depth[s])
        some = new.select("other", "id").limit(FEW + 1).collect()
        if len(some) <= FEW:
            front[s], size[s] = [r["id"] for r in some], len(some)
            met = min(((r["other"], r["id"]) for r in some if r["other"] is not None), default=None)
        else:
            front[s] = None
            size[s], met = new.agg(F.count("*"), F.min(F.when(F.col("other").isNotNull(), F.struct("other", "id")))).first()
        total[s] += size[s]
    path = _walk(seen[0], met[1], total[0])[::-1] + _walk(seen[1], met[1], total[1])[1:] if met else []
    for t in seen:
        t.release()
    if near is not edges:
        for t in near:
            storage.release(t)
    return path


def _walk(seen: storage.Growing, at: int, total: int) -> list[int]:
    """From a meeting node to the end that this side began from: in memory where few nodes were visited, else by one lookup a
    level, which reads that level's files alone."""
    held = seen.read()
    known = {r["id"]: r["parent"] for r in held.select("id", "parent").collect()} if total <= WALK else None
    out, depth = [at], None
    while True:
        if known is not None:
            parent = known[out[-1]]
        else:
            row = held.where((F.col("id") == out[-1]) if depth is None else (F.col("id") == out[-1]) & (F.col("depth") == depth)).first()
            parent, depth = row["parent"], row["depth"] - 1
        if parent is None:
            return out
        out.append(parent)


def hits(docs: DataFrame, ids: list[int]) -> DataFrame:
    """The ids' search hits in their order; an id without a document is a stub."""
    asked = docs.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id bigint")
    stub = {"t": F.lit(""), "x": F.lit(0.0), "y": F.lit(0.0), "r": F.lit(0.0), "cl": F.lit(0).cast("bigint")}
    return asked.join(docs.select("id", *stub), "id", "left").select("pos", "id", *[F.coalesce(F.col(k), v).alias(k) for k, v in stub.items()]).orderBy("pos")


def path(edges: DataFrame, docs: DataFrame, source: int, target: int) -> DataFrame:
    """One row (found, length, path): length counts nodes."""
    nodes = shortest_path(edges, source, target)
    rows = hits(docs, nodes)
    return rows.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "t", "x", "y", "r", "cl"))).alias("p")).select(F.lit(bool(nodes)).alias("found"), F.lit(len(nodes)).alias("length"), F.transform("p", lambda h: F.struct(*[h[k].alias(k) for k in ("id", "t", "x", "y", "r", "cl")])).alias("path"))
