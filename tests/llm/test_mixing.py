import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arcweave.llm import mixing
from tests.conftest import SMALL


def brute(rows, weights=None, budgets=mixing.BUDGETS, alpha=mixing.ALPHA):
    """{(doc_id, source): smallest budget} by sorting every source."""
    lean = [(d, s, len(re.findall(r"[^\x09-\x0d ]+", t or "")), int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)) for d, s, t in rows]
    total = defaultdict(int)
    for _, s, n, _ in lean:
        total[s] += n
    weight = {s: (t**alpha if weights is None else weights.get(s, 0.0)) for s, t in total.items()}
    scale = min([t / weight[s] for s, t in total.items() if t and weight[s]], default=0)
    out = []
    for s in total:
        mine = sorted((k, n, d) for d, s2, n, k in lean if s2 == s)
        for k, n, d in mine:
            upto = sum(m for j, m, _ in mine if j <= k)
            fit = [b for b in budgets if upto <= (0 if total[s] == 0 else int(b * weight[s] * scale + 0.5))]
            if fit:
                out.append((d, s, n, min(fit)))
    return out


def key(r):
    return tuple((x is None, x) if x is not None else (True, 0) for x in r)


@pytest.mark.parametrize("weights", [None, {"src0": 1.0, "src1": 3.0}])
def test_mix_is_brute_force(spark, weights):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = [tuple(r) for r in mixing.mix(docs, weights).select("doc_id", "source", "tokens", "budget").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, weights), key=key)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    got = [tuple(r) for r in mixing.mix(odd).select("doc_id", "source", "tokens", "budget").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    kept = mixing.sample(odd)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id or 0 for r in kept.collect()]) == sorted(d or 0 for d, *_ in brute(rows, budgets=(1.0,)))
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


def test_budgets_are_nested_and_a_small_source_is_whole(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs)
    assert got.where("source = 'small'").count() == 200
    n = {b: got.where(F.col("budget") <= b).agg(F.sum("tokens")).first()[0] for b in mixing.BUDGETS}
    assert abs(n[0.25] / n[1.0] - 0.25) < 0.02 and abs(n[0.5] / n[1.0] - 0.5) < 0.02
