"""Mixing sources to target weights with hash thresholds.

Every document has a key of 60 bits, the head of the MD5 of its doc_id. A source's budget is met by the documents whose
key is at most a threshold, so a smaller budget's documents are among a larger one's, and taking part is a comparison,
not a sort. Thresholds come from histograms: tokens by source and the key's first 12 bits; only the bucket in which a
budget ends is divided by the next 12 bits; only inside the bucket that then remains are keys summed one by one.

The largest budget is the most that the weights allow without repeating a source. Without given weights a source weighs
as its tokens to the power ALPHA, which lowers large sources. A token is a run of characters other than white space.

Defined results. A null text has 0 tokens; a very long one is counted whole, in one task; a null doc_id the key of the empty text; documents with equal keys (a repeated
doc_id) are taken or left together; documents without a source are one source, which null names. A source whose tokens
are 0 needs no budget and is taken whole. Sources missing from given weights weigh 0. Other columns are not read by mix()
and pass through sample(), whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm import util

BUDGETS = (0.25, 0.5, 1.0)
ALPHA = 0.7
TOP, MID = 1 << 48, 1 << 36


def key(doc_id: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x09-\x0D ]+")), F.lit(0)).cast("long")


def _lean(documents: DataFrame) -> DataFrame:
    return util.materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens().alias("tokens"), key().alias("key")), "mixing")


def budgets_of(lean: DataFrame, weights: dict[str, float] | None = None, budgets: tuple[float, ...] = BUDGETS, alpha: float = ALPHA) -> DataFrame:
    """(source, budget, limit): tokens that each source may have at each budget."""
    total = lean.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        weight = F.pow(F.col("total").cast("double"), F.lit(alpha))
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*given), F.coalesce("source", F.lit(""))), F.lit(0.0)) if given else F.lit(0.0)
    total = total.withColumn("weight", weight)
    scale = total.where("total > 0 and weight > 0").agg(F.min(F.col("total") / F.col("weight")).alias("scale"))
    limit = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.round(F.col("budget") * F.col("weight") * F.coalesce("scale", F.lit(0.0)))).cast("long")
    return total.crossJoin(scale).withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))).select("source", "budget", limit.alias("limit"))


def _same(a: DataFrame, b: DataFrame, *more: Column) -> Column:
    on = a["source"].eqNullSafe(b["source"])
    for x in more:
        on = on & x
    return on


def thresholds(lean: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, budget, threshold): documents with key <= threshold hold at most `limit` tokens, as many as can be."""
    by = Window.partitionBy("source").orderBy("bucket")
    top = lean.groupBy("source", F.expr(f"key div {TOP}").alias("bucket")).agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(by))
    top = util.materialize(top, "histogram")
    edge = limits.join(top, limits["source"].eqNullSafe(top["source"]), "left").where("upto > limit").groupBy(limits["source"], "budget", "limit").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("e"))
    edge = util.materialize(edge.select("source", "budget", "limit", F.col("e.bucket").alias("b1"), F.col("e.base").alias("base")), "histogram")
    near = lean.join(edge, _same(lean, edge, F.expr(f"key div {TOP}") == edge["b1"])).select(edge["source"], "budget", "limit", "b1", "base", "key", "tokens", F.expr(f"key div {MID} % 4096").alias("bucket"))
    near = util.materialize(near, "histogram")
    run = Window.partitionBy("source", "budget").orderBy("bucket")
    mid = near.groupBy("source", "budget", "limit", "b1", "base", "bucket").agg(F.sum("tokens").alias("n")).withColumn("upto", F.col("base") + F.sum("n").over(run)).where("upto > limit")
    mid = mid.groupBy("source", "budget").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("e")).select(F.col("source").alias("s2"), F.col("budget").alias("f2"), F.col("e.bucket").alias("b2"), F.col("e.base").alias("base2"))
    last = near.join(mid, F.expr("source <=> s2 and budget = f2 and bucket = b2")).select("source", "budget", "limit", "b1", "b2", "base2", "key", "tokens")
    keys = Window.partitionBy("source", "budget").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("base2") + F.sum("tokens").over(keys))
    found = last.groupBy("source", "budget").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("limit"), F.col("key"))), F.min(F.col("b1") * TOP + F.col("b2") * MID) - 1).alias("threshold"))
    return limits.join(found, _same(limits, found, limits["budget"] == found["budget"]), "left").select(limits["source"], limits["budget"], F.coalesce("threshold", F.lit((1 << 60) - 1)).alias("threshold"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, budgets: tuple[float, ...] = BUDGETS, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, source, tokens, budget) of the documents taken; budget is the smallest one that takes the document."""
    lean = _lean(documents)
    at = util.materialize(thresholds(lean, budgets_of(lean, weights, budgets, alpha)), "thresholds").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("budget", "threshold"))).alias("steps"))
    taken = lean.join(at, lean["source"].eqNullSafe(at["source"])).select("doc_id", lean["source"], "tokens", F.expr("get(filter(steps, s -> key <= s.threshold), 0).budget").alias("budget"))
    return taken.where("budget is not null")


def sample(documents: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """documents at the largest budget; all columns as they were."""
    lean = _lean(documents)
    at = util.materialize(thresholds(lean, budgets_of(lean, weights, (1.0,), alpha)), "thresholds").select(F.col("source").alias("__of"), F.col("threshold").alias("__most"))
    return documents.join(at, documents["source"].cast("string").eqNullSafe(at["__of"]) & (key() <= at["__most"]), "left_semi")


SQL = r"""
WITH lean AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x09-\x0D ]+')), 0) AS tokens,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key
  FROM {documents}),
total AS (SELECT source, sum(tokens) AS total, pow(sum(tokens)::DOUBLE, 0.7) AS weight FROM lean GROUP BY source),
scale AS (SELECT min(total / weight) AS scale FROM total WHERE total > 0),
limits AS (
  SELECT source, budget, CASE WHEN total = 0 THEN 0 ELSE round(budget * weight * coalesce(scale, 0.0)) END::BIGINT AS lim
  FROM total, scale, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) b(budget)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM lean)
SELECT doc_id, run.source, tokens::BIGINT AS tokens, min(budget) AS budget
FROM run JOIN limits ON run.source IS NOT DISTINCT FROM limits.source AND upto <= lim
GROUP BY doc_id, run.source, tokens, key, upto
"""
