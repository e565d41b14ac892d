import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm import toxicity as T
from tests.conftest import SMALL
from tests.llm.conftest import plain_words

FULL = (1 << 64) - 1


def mix(x: int, seed: int = 0) -> int:
    x = (x + seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & FULL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def word_hash(b: bytes, seed: int) -> int:
    piece = lambda k: int.from_bytes(b[8 * k : 8 * k + 8], "little")
    out = mix(piece(0) ^ (len(b) << 56 & FULL), 23)
    if len(b) > 8:
        out += sum(mix(piece(k) ^ mix(k, 29), 31) for k in range(1, (len(b) - 1) // 8 + 1)) + mix(len(b), 37)
    return mix(out & FULL, seed) >> 32


def brute(model: T.Classifier, text: str) -> float:
    """The score word by word, in whole numbers of Python."""
    found = set()
    for w in plain_words(text):
        b = w.encode()
        found.add(word_hash(b, 101))
        found |= {mix(mix(int.from_bytes(b[:n], "little"), 41), 102 + k) >> 32 for k, n in enumerate(T.PREFIXES) if len(b) > n}
    return model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights.tolist()) if f in found)


def test_scores_are_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    want = {r.doc_id: brute(model, r.text) for r in docs.collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-5 for d in want) and len(set(got.values())) > 3


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.where("doc_id % 2 = 0"))
    test = T.score(docs, model).alias("s").join(labels.where("doc_id % 2 = 1").selectExpr("doc_id", "toxic AS truth"), "doc_id").collect()
    hit = sum(r.toxic and r.truth for r in test)
    assert hit / sum(r.truth for r in test) > 0.85 and sum(r.toxic and not r.truth for r in test) / sum(not r.truth for r in test) < 0.01


def test_risk_is_not_negative_and_prior_matters():
    rng = np.random.default_rng(1)
    bad, words = np.uint32([1, 2, 3]), np.arange(10, 300).astype(np.uint32)
    pos = [np.unique(np.append(rng.choice(words, 30), rng.choice(bad, 2))) for _ in range(60)]
    unl = [np.unique(rng.choice(words, 30)) for _ in range(400)] + pos[:20]
    m = T.learn(pos, unl, 0.05)
    assert set(m.features.tolist()) == {1, 2, 3} and (m.weights > 0).all() and m.bias < 0
    assert T.learn([], unl).bias == -1 and not len(T.learn(pos, []).features)


def test_score_of_a_text_is_its_own(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)] + [(None, 1), (1, None), (10, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"some usual words number{i} here" + (" grobian lout" if i % 10 == 0 else "")) for i in range(200)], "doc_id long, text string")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == round(float(T.logits(model, pa.array([r.text]))[0]), 6)
    assert T.score(docs, model).where("toxic").count() == 20
    kept = T.filter_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() == T.score(odd, model).count()
    blank = T.score(odd, model).where("doc_id in (3, 4)").collect()
    assert len({r.score for r in blank}) == 1


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(none, labels)
    assert T.score(none, model).count() == 0 and T.filter_toxic(none, model).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert T.score(one, model).first()["score"] == -1 and not T.score(one, model).first()["toxic"]


def test_risk_has_this_gradient():
    """Finite differences of the risk: of both parts, and of the negative part turned round where it is below 0."""
    rng = np.random.default_rng(9)
    is_p = np.arange(30) < 10
    sides = set()
    for prior in (0.1, 0.9):
        z = rng.standard_normal(30) + 3 * is_p
        part = lambda z: np.array(T.risk(1 / (1 + np.exp(-z)), is_p, prior))  # noqa: B023, E731
        below = part(z)[1] < 0
        sides.add(bool(below))
        want = []
        for i in range(30):
            step = np.zeros(30)
            step[i] = 1e-6
            d = (part(z + step) - part(z - step)) / 2e-6
            want.append(-d[1] if below else d.sum())
        assert np.allclose(T.slopes(z, is_p, prior), want, atol=1e-8)
    assert sides == {True, False}


def test_equal_hashes_and_repeated_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one, two = T.fit(docs, labels), T.fit(docs.repartition(5), labels.unionByName(labels).repartition(3))
    assert np.array_equal(one.features, two.features) and np.allclose(one.weights, two.weights) and one.bias == pytest.approx(two.bias)
