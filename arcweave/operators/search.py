"""Ranked search in titles and their aliases that forgives typos.

An index is four tables: values (each title and kept alias), postings (term, id, value_no, pos), vocabulary (term, df) and
docs with normalised importance and their numbers of words and names, so that a query reads only its own terms. A query
becomes a handful of literal terms: the vocabulary is filtered by them, the matching terms meet the postings, and one
aggregation by document scores and checks that every required word is there.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import storage
from arcweave.functions import text as X

EXACT, STARTS, PHRASE, WEIGHT = 1000.0, 100.0, 10.0, 4.0
SLOP = 2
#: Terms that a filter names at most.
FEW = 1000
K1, B = 1.2, 0.75
CONNECTORS = frozenset("a an and at for in of on or the to".split())
HIT = ("id", "t", "x", "y", "r", "cl")


class Index(NamedTuple):
    docs: DataFrame
    values: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    n: int
    words: float  # tokens a document, on average
    names: float  # values a document, on average


def importance(docs: DataFrame) -> DataFrame:
    """docs with imp on a logarithmic scale from 0 to 1."""
    log = F.ln(F.greatest("imp", F.lit(1e-12)))
    ends = docs.agg(F.min(log).alias("_lo"), F.max(log).alias("_hi"))
    scaled = (log - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return docs.crossJoin(ends).withColumn("imp", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def values(docs: DataFrame) -> DataFrame:
    """(id, value_no, value): the title, then those aliases that bring other words than it and the aliases before."""
    every = docs.select("id", F.posexplode(F.concat(F.array("t"), F.coalesce("a", F.expr("cast(array() AS array<string>)")))).alias("value_no", "value"))
    keyed = every.withColumn("key", X.token_key(F.col("value")))
    first = Window.partitionBy("id", "key").orderBy("value_no")
    return keyed.withColumn("turn", F.row_number().over(first)).where("value_no = 0 or (turn = 1 and key <> '')").select("id", "value_no", "value")


def postings(held: DataFrame) -> DataFrame:
    return held.select("id", "value_no", F.posexplode(X.tokens(F.col("value"))).alias("pos", "term"))


def build(docs: DataFrame) -> Index:
    held = storage.materialize(values(docs).withColumn("raw", X.raw_token(F.col("value"))), "values")
    post = storage.materialize(postings(held).repartition("term"), "postings")
    vocabulary = storage.materialize(post.groupBy("term").agg(F.count_distinct("id").alias("df")), "vocabulary")
    sizes = held.groupBy("id").agg(F.count("*").alias("n_names")).join(post.groupBy("id").agg(F.count("*").alias("n_words")), "id", "left")
    scaled = storage.materialize(importance(docs).join(sizes, "id", "left").fillna(0, ["n_names", "n_words"]), "docs")
    return _index({"docs": scaled, "values": held, "postings": post, "vocabulary": vocabulary})


def _index(t: dict[str, DataFrame]) -> Index:
    n, words, names = t["docs"].agg(F.count("*"), F.sum("n_words"), F.sum("n_names")).first()
    return Index(t["docs"], t["values"], t["postings"], t["vocabulary"], n, (words or 0) / max(n, 1), (names or 0) / max(n, 1))


def read(spark: SparkSession, folder: str) -> Index:
    """An index that write() has left in folder."""
    return _index({k: spark.read.parquet(f"{folder}/{k}") for k in ("docs", "values", "postings", "vocabulary")})


def write(index: Index, folder: str) -> None:
    """Postings and vocabulary are sorted by term within range partitions, so a word's filter skips most row groups."""
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    index.values.repartitionByRange("raw").sortWithinPartitions("raw").write.mode("overwrite").parquet(f"{folder}/values")
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    index.vocabulary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocabulary")


def analyze(spark: SparkSession, query: str) -> tuple[list[str], str]:
    """The query's words, and the whole of it as one term."""
    row = spark.createDataFrame([(query,)], "q string").select(X.tokens(F.col("q")).alias("words"), X.raw_token(F.col("q")).alias("raw")).first()
    return row["words"], row["raw"]


def required(tokens: list[str]) -> list[int]:
    """Positions of the words that a document must match: the last, and the rest but for connectors beside real words."""
    real = any(t not in CONNECTORS for t in tokens)
    return [i for i, t in enumerate(tokens) if i == len(tokens) - 1 or not (real and t in CONNECTORS)]


def _idf(df: Column, n: int) -> Column:
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def _bm25(tf: Column, length: Column, mean: float, df: Column, n: int) -> Column:
    return _idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def matched_terms(vocabulary: DataFrame, token: str, last: bool) -> DataFrame:
    """(term, df, exact, fuzzy, prefix) of the terms that meet a word, and how."""
    exact = (F.col("term") == token) & F.lit(not last)
    fuzzy = X.similar(F.col("term"), F.lit(token)) if len(token) > 3 else F.lit(False)
    prefix = F.col("term").startswith(token) & F.lit(last)
    return vocabulary.select("term", "df", exact.alias("exact"), fuzzy.alias("fuzzy"), prefix.alias("prefix")).where("exact or fuzzy or prefix")


def word_scores(index: Index, token: str, last: bool) -> DataFrame:
    """(id, score) of the documents that match a word: BM25 for the word itself, 1 for a typo's reach, 1 for a prefix."""
    terms = matched_terms(index.vocabulary, token, last)
    few = terms.limit(FEW + 1).collect()
    postings = index.postings
    if len(few) <= FEW:  # their filter skips the postings of all other words
        postings = postings.where(F.col("term").isin([r["term"] for r in few])) if few else postings.where("false")
        terms = terms.sparkSession.createDataFrame(few, terms.schema)
    met = postings.join(terms, "term")
    lengths = index.docs.select("id", F.col("n_words").alias("length"))
    per = met.groupBy("id").agg(F.count_if("exact").alias("tf"), F.max(F.when(F.col("exact"), F.col("df"))).alias("df"), F.max(F.col("fuzzy").cast("int")).alias("fuzzy"), F.max(F.col("prefix").cast("int")).alias("prefix"))
    score = F.when(F.col("tf") > 0, _bm25(F.col("tf"), F.col("length"), index.words, F.col("df"), index.n)).otherwise(F.lit(0.0)) + F.col("fuzzy") + F.col("prefix")
    return (per.join(lengths, "id") if not last else per.withColumn("length", F.lit(1))).select("id", score.alias("score"))


def phrase_scores(index: Index, tokens: list[str]) -> DataFrame:
    """(id, score) of the documents with the words close together: their places, less their place in the query, lie within
    the slop. BM25 with the number of such places as frequency and the sum of the words' idf."""
    spot = lambda i: index.postings.where(F.col("term") == tokens[i]).select("id", "value_no", (F.col("pos") - i).alias(f"p{i}"))
    at = spot(0).withColumns({"low": F.col("p0"), "high": F.col("p0")})
    for i in range(1, len(tokens)):
        p = F.col(f"p{i}")
        at = at.join(spot(i), ["id", "value_no"]).withColumns({"low": F.least("low", p), "high": F.greatest("high", p)}).where(f"high - low <= {SLOP}").select("id", "value_no", "p0", "low", "high").distinct()
    idf = index.vocabulary.where(F.col("term").isin(tokens)).agg(F.sum(_idf(F.col("df"), index.n)).alias("idf"))
    lengths = index.docs.select("id", F.col("n_words").alias("length"))
    per = at.groupBy("id").agg(F.count_distinct("value_no", "p0").alias("tf")).join(lengths, "id").crossJoin(idf)
    return per.select("id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / index.words))).alias("score"))


def name_scores(index: Index, raw: str, exact: float = EXACT, starts: float = STARTS) -> DataFrame:
    """(id, score) of the documents with a name that is, or begins with, the whole query."""
    hit = index.values.where(F.col("raw").startswith(raw))
    per = hit.groupBy("id").agg(F.count_if(F.col("raw") == raw).alias("tf"))
    df = per.agg(F.count_if(F.col("tf") > 0).alias("df"))
    counts = index.docs.select("id", F.col("n_names").alias("length"))
    score = F.when(F.col("tf") > 0, _bm25(F.col("tf"), F.col("length"), index.names, F.col("df"), index.n) * exact).otherwise(F.lit(0.0)) + starts
    return per.join(counts, "id").crossJoin(df).select("id", score.alias("score"))


def scores(index: Index, query: str) -> DataFrame:
    """(id, score) of every document that matches."""
    spark = index.docs.sparkSession
    tokens, raw = analyze(spark, query)
    if not tokens:
        return spark.createDataFrame([], "id bigint, score double")
    if len(tokens) == 1 and len(tokens[0]) == 1:
        base = name_scores(index, tokens[0], starts=1.0)
    else:
        must = required(tokens)
        parts = [word_scores(index, t, i == len(tokens) - 1).select("id", "score", F.lit(i).alias("word")) for i, t in enumerate(tokens)]
        extra = [name_scores(index, raw)] + ([phrase_scores(index, tokens)] if len(tokens) > 1 else [])
        parts += [e.select("id", "score", F.lit(-1).alias("word")) for e in extra]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        base = every.groupBy("id").agg(F.count_distinct(F.when(F.col("word").isin(must), F.col("word"))).alias("met"), F.sum("score").alias("score")).where(F.col("met") == len(must)).select("id", "score")
    return base.join(index.docs.select("id", "imp"), "id").select("id", (F.col("score") * (1 + WEIGHT * F.coalesce("imp", F.lit(0.0)))).alias("score"))


def clamp(n: int | None) -> int:
    return max(1, min(50, 10 if n is None else n))


def search(index: Index, query: str, n: int | None = None) -> DataFrame:
    """The n best hits (id, t, x, y, r, cl, score), best first; equals by id."""
    top = scores(index, query).orderBy(F.col("score").desc(), "id").limit(clamp(n))
    return top.join(index.docs.select(*HIT), "id").select(*HIT, "score").orderBy(F.col("score").desc(), "id")


def bm25_estimate(tf: int, length: int, mean: float, df: int, n: int) -> float:
    """The same formula for one document, for tests."""
    return math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
