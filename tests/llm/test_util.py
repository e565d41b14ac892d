import pytest
from pyspark.sql import functions as F

from arcweave.llm import util
from tests.llm.test_rp_forest import groups


@pytest.mark.parametrize("stored", [True, False])
def test_rows_by_key(spark, tmp_path, stored):
    rows = spark.createDataFrame([(i, f"t{i}", i) for i in range(3000)] + [(None, "null", 1), (7, "again", 2)], "doc bigint, text string, __row int").repartition(3)
    if stored:
        rows.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
        rows = spark.read.parquet(str(tmp_path / "t"))
    ids = spark.range(0, 3000, 7).selectExpr("id AS doc")
    want = sorted(r.text for r in rows.collect() if r.doc is not None and r.doc % 7 == 0)
    some = util.among(rows.where("text <> 't14'"), ids, "doc")
    assert some.columns == rows.columns and sorted(r.text for r in some.collect()) == [t for t in want if t != "t14"]
    assert not stored or "Join" not in some._jdf.queryExecution().toString()  # found in place
    rest = util.without(rows, ids, "doc")
    assert rest.columns == rows.columns and sorted(r.text for r in rest.collect()) == sorted(r.text for r in rows.collect() if r.text not in want)
    assert util.without(rows, ids.limit(0), "doc").count() == rows.count() and util.without(rows.limit(0), ids, "doc").count() == 0
    clash = rows.withColumn("_metadata", F.lit("x"))
    assert util.without(clash, ids, "doc").count() == rest.count() and util.among(clash, ids, "doc").count() == len(want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, 2000), (2000, 1500), (5, 5), (None, 3), (7000, 7001), (7000, 7001)] + [(9000, 9001 + i) for i in range(500)]
    got = {r.id: r.group for r in util.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in groups([p for p in pairs if None not in p and p[0] != p[1]]).items()}
    assert util.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
