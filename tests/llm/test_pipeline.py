"""run() against stages that are written plainly, one document at a time."""

import pytest
import sentencepiece

import corpus_pipeline
from arcweave.llm import piece, toxicity
from tests.conftest import SMALL
from tests.llm import test_bagminhash, test_mixing, test_secrets, test_toxicity
from tests.llm.test_rp_forest import groups


def test_run_is_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    rows = [r for r in rows if test_toxicity.brute(model, r[2]) <= model.threshold]
    first = groups(test_bagminhash.brute([(d, t) for d, _, t in rows]))
    rows = [r for r in rows if first.get(r[0], r[0]) == r[0]]
    blank = []
    for d, s, t in rows:
        for a, b, rule in reversed(test_secrets.brute(t) if any(k in t.lower() for k in ("token", "secret", "key", "passw", "_", "eyj")) else []):
            t = f"{t[:a]}[SECRET:{rule}]{t[b:]}"
        blank.append((d, s, t))
    taken = {d for d, *_ in test_mixing.brute(blank, budgets=(1.0,))}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece.MODEL)
    want = sorted((d, sp.encode(t)) for d, _, t in blank if d in taken)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want and 50 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "secret_scans", "source_mixing", "sentencepiece"]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, plain, odd.limit(0)):  # extra columns with clashing names pass
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
            docs = stage(spark, docs, SMALL)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_registered():
    import __spark_entry__ as entry
    from arcweave.llm import queries

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_source_mixing", "op7_embedding_near_dedup", "quality_ablation", "near_duplicate_groups", "planted_embedding_groups"])
def test_sql_agrees(spark, name):
    import duckdb

    from arcweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    order = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert cols == sorted(want.columns) and order(got) == order(want)
