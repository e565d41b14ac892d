"""Shapes the driver's tables into what the operators read. Where an adapter is only projection, Spark and the oracle share
its SQL; {names} are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators import extract, graph

#: A dump of wiki pages from documents: chains of redirects, links in all written forms, links that don't count.
DUMP = """
SELECT '<page><title>d_' || CAST(doc_id AS STRING) || '</title><ns>' || CASE WHEN doc_id % 17 = 0 THEN '4' ELSE '0' END
    || '</ns><text xml:space="preserve">'
    || CASE WHEN doc_id % 10 IN (3, 4) THEN '#REDIRECT [[D ' || CAST(doc_id + 1 AS STRING) || ']]'
       ELSE 'See [[d ' || CAST((7 * doc_id + 1) % n AS STRING) || ']], [[D_' || CAST((13 * doc_id + 5) % n AS STRING) || '|there]] and [[ D '
         || CAST((doc_id * doc_id) % n AS STRING) || ' #part]].&lt;ref name=&quot;a&quot;&gt;[[D 1]]&lt;/ref&gt; [[File:D 2.png]] '
         || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' == References == [[D 3]]' END
    || '</text></page>' AS xml
FROM {documents} CROSS JOIN (SELECT count(*) AS n FROM {documents})
"""

#: Nodes with a place, a cluster and a rank from embeddings; ids are vec_id.
SPATIAL = """
SELECT vec_id AS id, 'V ' || CAST(vec_id AS STRING) AS title, CAST(1 + (vec_id * 7919) % 1009 AS DOUBLE) / 100000 AS pagerank,
       CAST(label AS BIGINT) AS `partition`, CAST(embedding[{first}] AS DOUBLE) * 65536 AS x, CAST(embedding[{second}] AS DOUBLE) * 65536 AS y,
       CAST(200 + 40 * label AS DOUBLE) AS radius
FROM {embeddings}
"""

#: Three links out of every node of SPATIAL.
NEAR = """
SELECT DISTINCT src, dst FROM (
  SELECT vec_id AS src, (7 * vec_id + 1) % n AS dst FROM {embeddings} CROSS JOIN (SELECT count(*) AS n FROM {embeddings})
  UNION ALL SELECT vec_id, (13 * vec_id + 5) % n FROM {embeddings} CROSS JOIN (SELECT count(*) AS n FROM {embeddings})
  UNION ALL SELECT vec_id, (vec_id * vec_id) % 50 FROM {embeddings}) e
WHERE src <> dst
"""

#: Customers and the suppliers that they bought of, suppliers after customers in one space of ids.
TRADE = """
SELECT DISTINCT o_custkey AS src, 1000000000 + l_suppkey AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
"""

#: Titles to search in, with other names: parts, and the titles of web pages after them.
TITLES = """
SELECT p_partkey AS id, p_name AS t, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 100 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS r, CAST(p_size AS BIGINT) AS cl,
       p_retailprice / 1000000 AS imp, p_brand || ' ' || p_type AS a1, upper(p_name) AS a2
FROM {part}
UNION ALL
SELECT 1000000000 + page_id, {title}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(2 AS DOUBLE), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) / (1000 + page_id), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {pages}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In as many partitions as there are cores where the file has fewer, so that its few row groups aren't a few tasks."""
    out, cores = spark.sql(DUMP, documents=table(spark, sf_dir, "documents")), spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out.rdd.getNumPartitions() < cores else out


def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPATIAL.replace("{first}", "0").replace("{second}", "1"), embeddings=table(spark, sf_dir, "embeddings"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NEAR, embeddings=table(spark, sf_dir, "embeddings"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRADE, orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents (id, t, x, y, r, cl, imp, a)."""
    found = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    flat = spark.sql(TITLES.replace("{title}", found), part=table(spark, sf_dir, "part"), pages=table(spark, sf_dir, "pages"))
    return flat.select("id", "t", "x", "y", "r", "cl", "imp", F.array_compact(F.array("a1", "a2")).alias("a"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a user and the one whose event came next. The order is a distributed one, and next is a join."""
    at = extract.dense_ids(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "ts", "event_id")
    one, two = at.select("id", F.col("user_id").alias("src")), at.select((F.col("id") - 1).alias("id"), F.col("user_id").alias("dst"))
    return graph.clean(one.join(two, "id"))


def _fill(sql: str, **more: str) -> str:
    for k, v in more.items():
        sql = sql.replace("{" + k + "}", v)
    for t in ("documents", "embeddings", "orders", "lineitem", "part", "pages", "events"):
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("`", '"')


DUMP_SQL = _fill(DUMP)
SPATIAL_SQL = _fill(SPATIAL, first="1", second="2")
NEAR_SQL = _fill(NEAR)
TRADE_SQL = _fill(TRADE)
TITLES_SQL = _fill(TITLES, title="regexp_extract(html, '<title>([^<]*)</title>', 1)")
TRANSITIONS_SQL = """
SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst
"""
