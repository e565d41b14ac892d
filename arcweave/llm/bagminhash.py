"""Near-duplicate documents by weighted MinHash signatures of their token multisets.

A document is a multiset of runs of GRAM words. For each token a marked Poisson process lies over weight x time, the same
in every document. Its weight axis is discretised hierarchically: region 0 is [0, 1), region j is [2**(j-1), 2**j), and
the process of region j has the rate of its width, so one draw serves all unit cells of a region at once. A token of
weight w takes the points of the regions that w reaches and drops those whose cell lies above w, at most half of all.
Each point carries one of M signature components; a component keeps the earliest point of the document. Two documents
agree in a component with the probability of their weighted Jaccard similarity, exactly. Points come in order of time and
a document stops when the next is later than its latest component, so n tokens cost n + M log M points.

Identical texts are one document from the start. Signatures are cut into BANDS bands; in each bucket, parted by a hash,
every document is paired with its part's first and with the one before it, and so are the parts' first documents; pairs
whose signatures agree too little are dropped, and the multisets of the rest are compared exactly. Pairs of at least
SIMILAR are joined to groups. Then all pairs of a bucket that aren't in one group yet are compared in the same way, so the
groups are those of all pairs in all buckets.

Defined results. A null text or null doc_id takes no part; an empty text, or one with no word, equals only texts that are
identical to it. A text with fewer than GRAM words is one token. A very long text is one row of one task, which needs some
12 bytes a byte of it. Equal similarities aren't told apart; the group doesn't depend on them. Rows that repeat a doc_id are one document, and stay or
go together. The group is named by, and keeps, its smallest doc_id. An empty table gives an empty result. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm import textnum, util

GRAM = 2
BANDS = 40
ROWS = 4
SIMILAR = 0.5
SLACK = 0.15
#: Parts of a bucket.
SALTS = 64
U = textnum.U


def bags(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, sorted, with their counts: (token, count, row pointers)."""
    w = textnum.words(texts)
    n = np.diff(w.rows)
    h = w.hash()
    if (short := np.flatnonzero((n > 0) & (n < gram))).size:  # repeat the last word, so that they have one token
        times = np.ones(len(h), np.int64)
        times[w.rows[short + 1] - 1] += gram - n[short]
        h, n = np.repeat(h, times), np.where((n > 0) & (n < gram), gram, n)
    g, rows = textnum.grams(h, np.concatenate([[0], np.cumsum(n)]), gram)
    row = np.repeat(np.arange(len(n)), np.diff(rows))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return g[at], np.diff(np.append(at, len(g))), np.searchsorted(row[at], np.arange(len(n) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(token: np.ndarray, count: np.ndarray, rows: np.ndarray, m: int) -> np.ndarray:
    """The times of the m components of each row; infinity in a row without tokens."""
    docs = len(rows) - 1
    sig = np.full(docs * m, np.inf)
    doc = np.repeat(np.arange(docs), np.diff(rows))
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(token)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, weight = doc[element], count[element].astype(np.float64)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    state = textnum.mix(token[element] ^ (level.astype(U) << U(48)), 11)
    time = np.zeros(len(element))
    latest = np.full(docs, np.inf)
    draw = 0
    while len(state):
        draw += 1
        u = textnum.mix(state + U(draw * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF), 3)
        time = time - np.log(_uniform(u)) / width
        v = textnum.mix(u, 5)
        cell = low + np.floor(_uniform(textnum.mix(v, 7)) * width)
        on = time < latest[doc]
        hit = np.flatnonzero(on & (cell < weight))
        where = doc[hit] * m + (v[hit] % U(m)).astype(np.int64)
        np.minimum.at(sig, where, time[hit])
        touched = np.unique(doc[hit])
        latest[touched] = sig.reshape(docs, m)[touched].max(1)
        keep = np.flatnonzero(time < latest[doc])
        state, time, doc, weight, low, width = state[keep], time[keep], doc[keep], weight[keep], low[keep], width[keep]
    return sig.reshape(docs, m)


def _sign(gram: int, bands: int, rows: int):
    schema = pa.schema([("doc", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.pieces(batch, "text", 1 << 20):
                token, count, ptr = bags(part.column(1), gram)
                sig = signatures(token, count, ptr, bands * rows)
                has = np.diff(ptr) > 0
                bits = textnum.mix(sig[has].view(U))
                key = np.zeros((len(bits), bands), U)
                for r in range(rows):
                    key = textnum.mix(key ^ bits[:, r::rows], 13)
                key = textnum.mix(key ^ np.arange(bands, dtype=U), 17)
                docs = part.column(0).to_numpy(zero_copy_only=False)[has]
                short = (bits & U(0xFFFF)).astype(np.uint16)
                off = np.arange(len(docs) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(key.view(np.int64).ravel()))], schema=schema)

    return run


def _agree(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array([np.frombuffer(s, np.uint16) for s in batch.column(i).to_pylist()]) for i in (2, 3))
            if len(x):
                ok = pa.array((x == y).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=schema)

    return run


def _overlap(gram: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in textnum.pieces(batch, "text_a", 1 << 20):
                for part in textnum.pieces(half, "text_b", 1 << 20):
                    n = part.num_rows
                    token, count, ptr = bags(pa.concat_arrays([part.column(2), part.column(3)]), gram)
                    pair = np.repeat(np.arange(2 * n) % n, np.diff(ptr))
                    order = np.lexsort((token, pair))
                    t, p, c = token[order], pair[order], count[order]
                    both = np.flatnonzero((t[1:] == t[:-1]) & (p[1:] == p[:-1]))
                    common = np.bincount(p[both], np.minimum(c[both], c[both + 1]), n)
                    total = np.bincount(pair, count, n)
                    sim = common / np.maximum(total - common, 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], schema=schema)

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")


def _verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame, gram: int, similar: float, slack: float) -> DataFrame:
    """(a, b, similarity) of those pairs (a, b) whose multisets are at least `similar`."""
    sig = lambda k: signed.select(F.col("doc").alias(k), F.col("sig").alias("sig_" + k))
    pairs = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree(similar - slack), "a long, b long").distinct()
    pairs = util.materialize(pairs, "pairs")
    wanted = util.materialize(util.among(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc"), "texts")
    one = wanted.dropDuplicates(["doc"])
    text = lambda k: one.select(F.col("doc").alias(k), F.col("text").alias("text_" + k))
    checked = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlap(gram), "a long, b long, similarity double")
    checked = util.materialize(checked.where(F.col("similarity") >= similar), "pairs")
    util.release(wanted)
    util.release(pairs)
    return checked


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: every document of a bucket (doc, band) with the first and the one before it. A bucket is divided by a
    hash of the document into SALTS parts, whose first documents then meet, so that no task has the whole of a hot one."""

    def seats(rows: DataFrame, *parts: str) -> DataFrame:
        by = Window.partitionBy("band", *parts).orderBy("doc")
        return rows.withColumns({"head": F.first("doc").over(by.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lag("doc").over(by)})

    part = util.materialize(seats(rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(SALTS))), "part"), "seats")
    both = part.unionByName(seats(part.where("doc = head").select("doc", "band", "part")))
    return both.where("head < doc").select(F.explode(F.array_distinct(F.array("head", "last"))).alias("a"), F.col("doc").alias("b")).where("a < b").distinct()


def near_pairs(documents: DataFrame, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR, slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): exact copies (a, b), b > a the first document with that text; and verified pairs
    (a, b, similarity) among the first documents of each text."""
    docs = _texts(util.small_batches(documents))
    lean = docs.select("doc", F.md5("text").alias("sum"))
    first = lean.groupBy("sum").agg(F.min("doc").alias("a"), F.max("doc").alias("z"))
    copied = first.where("a < z")
    copies = util.materialize(lean.join(copied, "sum").where("doc > a").select("a", F.col("doc").alias("b")).distinct(), "copies")
    signed = util.materialize(docs.mapInArrow(_sign(gram, bands, rows), "doc long, sig binary, bands array<long>"), "signatures")
    alone = signed.join(copies.select(F.col("b").alias("doc")).distinct(), "doc", "left_anti")  # signatures move, not texts
    rows_of = alone.select("doc", F.explode("bands").alias("band"))
    star = util.materialize(_stars(rows_of), "pairs")
    checked = _verified(docs, signed, star, gram, similar, slack)
    group = util.components(checked)
    held = rows_of.join(group.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "band", F.coalesce("group", "doc").alias("group"))
    of_band = Window.partitionBy("band")
    held = held.withColumns({"low": F.min("group").over(of_band), "high": F.max("group").over(of_band)}).where("low < high").select("doc", "band", "group")
    held = util.materialize(held, "seats")  # buckets of several groups
    other = held.select("band", F.col("doc").alias("b"), F.col("group").alias("group_b"))
    apart = held.withColumnRenamed("doc", "a").join(other, "band").where((F.col("a") < F.col("b")) & (F.col("group") != F.col("group_b"))).select("a", "b").distinct()
    rest = util.materialize(apart.join(star, ["a", "b"], "left_anti"), "pairs")
    util.release(held)
    util.release(star)
    if not rest.isEmpty():
        checked = checked.unionByName(_verified(docs, signed, rest, gram, similar, slack))
    util.release(rest)
    util.release(signed)
    return copies, checked


def near_duplicates(documents: DataFrame, gram: int = GRAM, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, group_id, similarity) for every document of a group of at least two; group_id is its smallest doc_id, the
    one that stays. similarity is the largest of the verified ones with another member; 1 for exact copies."""
    copies, pairs = near_pairs(documents, gram, bands, rows, similar)
    edges = copies.select("a", "b", F.lit(1.0).alias("similarity")).unionByName(pairs)
    group = util.components(edges)
    best = edges.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("similarity"))
    return group.join(best, "id").select(F.col("id").alias("doc_id"), F.col("group").alias("group_id"), "similarity")


def deduplicate(documents: DataFrame, **parameters) -> DataFrame:
    """documents without those near-duplicates that their group doesn't keep; all other rows and columns as they were."""
    gone = near_duplicates(documents, **parameters).where("doc_id <> group_id").select("doc_id").distinct()
    return util.without(documents, util.materialize(gone, "gone"), "doc_id")
