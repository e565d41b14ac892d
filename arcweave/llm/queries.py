"""The operators over their whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import bagminhash, chat, compact_windows, mixing, piece, quality, rp_forest, secret_scan, separators, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, table))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, and near copies of all: each vector with a little of its label's neighbour dimension in every place."""
    own = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = own.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.expr("transform(embedding, (v, i) -> v * (1 + 0.3 * ((i + vec_id) % 3 - 1)))").alias("embedding"))
    return own.unionByName(near)


_PLANTED = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
 SELECT vec_id + 1000000000, list_transform(embedding::DOUBLE[], lambda v, i: v * (1 + 0.3 * ((i - 1 + vec_id) % 3 - 1))) FROM embeddings)"""

#: Groups as the transitive closure of all pairs; {{pairs}} is a table pairs(a, b), a < b.
_GROUPS = """, link AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS other FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other)"""
_PAIRS = """unit AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_sum(list_transform(e, lambda y: y * y))))::FLOAT) AS u FROM v WHERE len(e) > 0),
pairs AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.u, y.u) AS s FROM unit x JOIN unit y ON x.vec_id < y.vec_id WHERE list_inner_product(x.u, y.u) >= 0.9)"""

#: Words of a text as textnum has them, for texts whose capitals are ASCII or Latin-1.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{00C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _on("documents", lambda d: quality.decide(quality.store(d))),
    "op2_source_mixing": _on("documents", mixing.mix),
    "op3_chat_formatting": _on("conversations", chat.format_chats),
    "op4_token_counts": _on("documents", separators.document_token_counts),
    "op5_secret_scans": _on("documents", secret_scan.find_secrets),
    "op6_toxicity": op6,
    "op7_embedding_near_dedup": _on("embeddings", rp_forest.near_duplicates),
    "op8_sentencepiece": _on("documents", piece.encode_documents),
    "op9_minhash_near_dedup": _on("documents", bagminhash.near_duplicates),
    "op10_substring_dedup": _on("documents", compact_windows.repeated_passages),
    "planted_embedding_groups": lambda spark, sf_dir: rp_forest.near_duplicates(planted(spark, sf_dir)).select("vec_id", "group_id"),
    "near_duplicate_groups": _on("documents", lambda d: bagminhash.near_duplicates(d).select("doc_id", "group_id")),
    "quality_ablation": _on("documents", lambda d: quality.ablate(quality.store(d))),
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.decide_sql(),
    "op2_source_mixing": mixing.SQL.format(documents="documents"),
    "quality_ablation": quality.ablate_sql(),
    "op7_embedding_near_dedup": f"WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_PAIRS}{_GROUPS} SELECT id AS vec_id, min(other) AS group_id, (SELECT round(max(s)::DOUBLE, 6) FROM pairs WHERE a = id OR b = id) AS similarity FROM reach GROUP BY id",
    "planted_embedding_groups": f"WITH RECURSIVE {_PLANTED}, {_PAIRS}{_GROUPS} SELECT id AS vec_id, min(other) AS group_id FROM reach GROUP BY id",
    "near_duplicate_groups": f"""WITH RECURSIVE w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, CASE WHEN len(w) = 1 THEN [w[1], w[1]] ELSE w END AS w FROM w),
gram AS (SELECT doc_id, unnest(list_zip(w[1:len(w) - 1], w[2:])) AS g FROM p WHERE len(w) > 1), bag AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM gram GROUP BY ALL), size AS (SELECT doc_id, sum(n) AS n FROM bag GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS m FROM bag x JOIN bag y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM met JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 2 * m >= s.n + t.n - m UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id){_GROUPS}
SELECT id AS doc_id, min(other) AS group_id FROM reach GROUP BY id""",
}
