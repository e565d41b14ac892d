"""Modularity and communities of an undirected graph given as pairs (a, b), a < b."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import storage
from arcweave.functions import hashing

#: Modularity that four rounds of moves must gain.
GAIN = 1e-4
#: Pairs with which one task does all rounds: some 200 bytes each.
HELD = 8_000_000


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): the share of edges inside communities less what random edges with the same degrees give."""
    lab = lambda v, c: labels.select(F.col("id").alias(v), F.col("label").alias(c))
    both = pairs.join(lab("a", "la"), "a").join(lab("b", "lb"), "b")
    m = both.agg(F.count("*").cast("double").alias("m"))
    inside = both.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("inside"))
    ends = both.select(F.explode(F.array("la", "lb")).alias("label")).groupBy("label").agg(F.count("*").alias("ends"))
    per = ends.join(inside, "label", "left").crossJoin(m)
    return per.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("ends") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def _quality(flows: DataFrame, nodes: DataFrame, two_m: float, resolution: float) -> float:
    """Modularity of nodes(id, k, label), but for what loops give to all alike."""
    lab = lambda v, c: nodes.select(F.col("id").alias(v), F.col("label").alias(c))
    inside = flows.join(lab("src", "la"), "src").join(lab("dst", "lb"), "dst").where("la = lb").agg(F.sum("w")).first()[0] or 0.0
    spread = nodes.groupBy("label").agg(F.sum("k").alias("tot")).agg(F.sum(F.pow(F.col("tot") / two_m, F.lit(2)))).first()[0] or 0.0
    return inside / two_m - resolution * spread


def _local_moves(flows: DataFrame, nodes: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """nodes(id, k, label, part) after rounds in which a node moves where modularity gains most, within its part. In a round
    only nodes of one hash parity move, else neighbours would swap for ever; ties go to the smallest label. It ends when no
    node has moved in a round of either parity, or when four rounds have brought modularity less than GAIN."""
    turn, best, idle = 0, None, 0
    while idle < 2:
        if turn % 4 == 0:
            now = _quality(flows, nodes, two_m, resolution)
            if best is not None and now < best + GAIN:
                break
            best = now
        total = nodes.groupBy("label").agg(F.sum("k").alias("tot"))
        near = flows.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("to"), F.col("part").alias("part2")), "dst").join(nodes.select(F.col("id").alias("src"), "k", "label", "part"), "src").where("part = part2")
        links = near.groupBy("src", "k", "label", "to").agg(F.sum("w").alias("w"))
        own = links.where("label = to").select("src", F.col("w").alias("w0"))
        gain = (F.col("w") - F.coalesce("w0", F.lit(0.0))) - F.lit(resolution) * F.col("k") * (F.col("tot") - (F.col("tot0") - F.col("k"))) / F.lit(two_m)
        tried = links.where("label <> to").join(own, "src", "left").join(total.withColumnsRenamed({"label": "to"}), "to").join(total.select("label", F.col("tot").alias("tot0")), "label")
        target = tried.select("src", "to", gain.alias("gain")).where((F.col("gain") > 1e-9) & (F.pmod(F.xxhash64("src", F.lit(turn // 2)), F.lit(2)) == turn % 2))
        target = target.groupBy("src").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("m")).select(F.col("src").alias("id"), (-F.col("m.to")).alias("to"))
        new = storage.materialize(nodes.join(target, "id", "left").select("id", "k", F.coalesce("to", "label").alias("label"), "part", F.col("to").isNotNull().alias("moved")), "moves")
        moved = new.where("moved").count()
        if turn:
            storage.release(held)
        nodes, held = new.drop("moved"), new
        idle, turn = 0 if moved else idle + 1, turn + 1
    return nodes


def connected_parts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, label) with every label split into its connected parts, each named by its smallest id. Labels spread along
    inner edges with pointer jumps, so the rounds grow with the logarithm of the diameter."""
    lab = lambda v, c: labels.select(F.col("id").alias(v), F.col("label").alias(c))
    inner = pairs.join(lab("a", "la"), "a").join(lab("b", "lb"), "b").where("la = lb")
    inner = storage.materialize(inner.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"), "inner")
    part = storage.materialize(labels.select("id", F.col("id").alias("root")), "parts")
    while True:
        low = inner.join(part.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("low"))
        step = part.join(low, "id", "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        jump = step.join(part.select(F.col("id").alias("low"), F.col("root").alias("over")), "low").select("id", F.least("low", "over").alias("new"), "root")
        new = storage.materialize(jump, "parts")
        changed = new.where("new <> root").count()
        part = new.select("id", F.col("new").alias("root"))
        if not changed:
            return part.select("id", F.col("root").alias("label"))


def leiden(pairs: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, label): communities by local moves, refinement and aggregation until nothing moves. Refinement here splits each
    community into connected parts, so that none falls apart; parts become the next pass's nodes and start from the
    community that they are in. Labels are the smallest id; two runs give the same. At most HELD pairs go through the same
    rounds in one task."""
    lean = storage.materialize(pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")), "pairs")
    if lean.count() <= HELD:
        out = storage.by_one([lean], lambda t: _in_memory(t, resolution), "id bigint, label bigint", "communities")
        storage.release(lean)
        return out
    pairs = lean
    flows = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w"))
    flows = storage.materialize(flows, "flows")
    two_m = float(flows.count())
    ids = flows.select(F.col("src").alias("id")).distinct()
    member = storage.materialize(ids.select("id", F.col("id").alias("node")), "member")
    start = None
    while True:
        weight = flows.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
        nodes = weight.withColumn("label", F.col("id")) if start is None else weight.join(start, "id")
        nodes = storage.materialize(nodes.withColumn("part", F.lit(0)), "nodes")
        before = nodes.select("label").distinct().count()
        inner = flows.where("src <> dst")
        moved = _local_moves(inner, nodes, two_m, resolution).select("id", "label")
        moved = storage.materialize(moved, "moved")
        parts = storage.materialize(connected_parts(inner.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), moved), "refined")
        member = storage.materialize(member.join(parts.select(F.col("id").alias("node"), F.col("label").alias("to")), "node").select("id", F.col("to").alias("node")), "member")
        to = lambda v: parts.select(F.col("id").alias(v), F.col("label").alias("n" + v))
        flows = storage.materialize(flows.join(to("src"), "src").join(to("dst"), "dst").groupBy(F.col("nsrc").alias("src"), F.col("ndst").alias("dst")).agg(F.sum("w").alias("w")), "flows")
        start = parts.join(moved.withColumnsRenamed({"label": "home"}), "id").groupBy(F.col("label").alias("id")).agg(F.min("home").alias("label"))
        start = storage.materialize(start, "start")
        if start.count() == before:
            break
    out = member.join(start.select(F.col("id").alias("node"), "label"), "node").select("id", "label")
    original = storage.materialize(out, "communities")
    name = Window.partitionBy("label")
    return connected_parts(pairs, original.select("id", F.min("id").over(name).alias("label")))


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected part."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[u], root[v]), root.copy()
        for at in (u, v, root[u], root[v]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)


def _moves(ids: np.ndarray, s: np.ndarray, d: np.ndarray, w: np.ndarray, k: np.ndarray, label: np.ndarray, two_m: float, resolution: float) -> np.ndarray:
    """_local_moves of all nodes over flows without loops; k is 0 for nodes that this pass doesn't have."""
    n, label = len(ids), label.copy()
    turn, best, idle = 0, None, 0
    while idle < 2:
        total = np.bincount(label, k, n)
        if turn % 4 == 0:
            now = w[label[s] == label[d]].sum() / two_m - resolution * ((total / two_m) ** 2).sum()
            if best is not None and now < best + GAIN:
                break
            best = now
        on = np.flatnonzero((hashing.xxhash64([ids], turn // 2) & 1)[s] == turn % 2)
        key = s[on] * n + label[d[on]]
        order = np.argsort(key)
        key, first = key[order], None
        first = _first(key)
        weight = np.add.reduceat(w[on][order], first) if len(first) else np.zeros(0)
        src, to = np.divmod(key[first], n)
        stay = to == label[src]
        own = np.zeros(n)
        own[src[stay]] = weight[stay]
        src, to, weight = src[~stay], to[~stay], weight[~stay]
        gain = (weight - own[src]) - resolution * k[src] * (total[to] - (total[label[src]] - k[src])) / two_m
        at = _first(src)
        most = np.repeat(np.maximum.reduceat(gain, at), np.diff(np.append(at, len(src)))) if len(at) else gain
        hit = np.flatnonzero((gain == most) & (gain > 1e-9))
        hit = hit[_first(src[hit])]  # labels rise within a node
        label[src[hit]] = to[hit]
        idle, turn = 0 if len(hit) else idle + 1, turn + 1
    return label


def _in_memory(table: pa.Table, resolution: float) -> dict:
    """leiden() over arrays; nodes are positions among the sorted ids, so that their order is that of ids."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, a, b = len(ids), at[: len(a)], at[len(a) :]
    s, d, w, two_m = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), 2.0 * len(a)
    member, label = np.arange(n), np.arange(n)
    while n:
        here = np.unique(s)
        k, before = np.bincount(s, w, n), len(np.unique(label[here]))
        far = s != d
        label = _moves(ids, s[far], d[far], w[far], k, label, two_m, resolution)
        inner = far & (label[s] == label[d])
        part = _roots(s[inner], d[inner], n)
        member = part[member]
        key = part[s] * n + part[d]
        order = np.argsort(key)
        first = _first(key[order])
        w = np.add.reduceat(w[order], first)
        s, d = np.divmod(key[order][first], n)
        # a part's nodes have one label, its first node's among them
        if len(np.unique(part[here])) == before:
            break
    label = label[member]
    inner = label[a] == label[b]
    return {"id": ids, "label": ids[_roots(a[inner], b[inner], n)]}
