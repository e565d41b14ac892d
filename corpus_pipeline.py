"""From raw documents to token ids: toxic documents go, one of each group of near-duplicates stays, secrets are blanked,
sources are sampled to their weights, and the rest is encoded. Each stage is written and read again before the next.

The stages keep the columns of documents, but the last, which gives what encode_documents gives. A stage's table is
deleted when the next one's is written.

Defined results. A null text passes every stage (it has no toxic feature, no copy, no secret and no tokens) and ends with
null ids; an empty one ends with none, and identical empty ones are copies. A null doc_id takes no part in the search for
copies, so it stays there; all such rows have one key in the mixing. Repeated rows stay or go together until one source's
budget decides, by their key. Very long texts are whole in every stage. Ties: a group keeps its smallest doc_id. A stage
passes extra columns on, whatever their names, except the last, which has its own. Empty tables give empty results, as does
a table of labels without a toxic one leave all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import bagminhash, mixing, piece, secret_scan, toxicity, util


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on the stage's own documents and the table of labels."""
    return toxicity.filter_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicate(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", blank_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the signatures and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = util.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        util.release(docs)
        docs = made
    return docs
