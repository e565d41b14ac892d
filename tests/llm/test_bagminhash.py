from collections import Counter

import numpy as np
import pyarrow as pa

from arcweave.llm import bagminhash as B
from tests.conftest import SMALL
from tests.llm.conftest import plain_words, prose
from tests.llm.test_rp_forest import groups


def bag(text: str) -> Counter:
    w = plain_words(text)
    w += [w[-1]] * (B.GRAM - len(w)) if w else []
    return Counter(tuple(w[i : i + B.GRAM]) for i in range(len(w) - B.GRAM + 1))


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, similar=B.SIMILAR):
    bags = {d: bag(t) for d, t in rows}
    texts = dict(rows)
    ids = sorted(bags)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if texts[a] == texts[b] or bags[a] and jaccard(bags[a], bags[b]) >= similar]


def test_signatures_estimate_weighted_jaccard():
    texts = [prose(1, 300), prose(1, 150) + " " + prose(2, 150), prose(1, 300) + " " + prose(1, 300), "rye " * 90 + prose(3, 30), "rye " * 60 + prose(3, 30)]
    token, count, rows = B.bags(pa.array(texts))
    sig = B.signatures(token, count, rows, 4096)
    for i in range(len(texts)):
        for j in range(i):
            assert abs((sig[i] == sig[j]).mean() - jaccard(bag(texts[i]), bag(texts[j]))) < 0.04
    one = B.signatures(*B.bags(pa.array(texts[2:3])), 4096)
    assert np.array_equal(one[0], sig[2])  # whatever else is in the batch


def test_groups_are_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = groups(brute([(r.doc_id, r.text) for r in docs.collect()]))
    got = {r.doc_id: r.group_id for r in B.near_duplicates(docs).collect()}
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in B.deduplicate(docs).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if want.get(r.doc_id, r.doc_id) == r.doc_id}


def test_recall_near_the_threshold(spark):
    rows, want = [], []
    for i in range(120):
        words = prose(100 + i, 200).split()
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[: 150 - i % 10] + prose(900 + i, 50).split())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r.doc_id: r.group_id for r in B.near_duplicates(docs).collect()}
    assert len(want) > 50 and sum(got.get(a, -1) == got.get(b, -2) for a, b in want) >= 0.9 * len(want)
    true = groups(want)
    assert all(k in true for k in got)


def family(pairs: int = 60) -> list[tuple[int, str]]:
    """Documents of one template, about 0.42 similar to each other, and their near copies of about 0.54, ids interleaved."""
    rng, rows = np.random.default_rng(8), []
    unique = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    template = unique(178)
    for i in range(pairs):
        own = unique(32)
        rows += [(i, " ".join(template + own + unique(90))), (pairs + (i * 7) % pairs, " ".join(template + own + unique(90)))]
    return rows


def test_pairs_within_a_family_of_one_template(spark):
    rows = family()
    want = brute(rows)
    got = {r.doc_id: r.group_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) == 60 and sum(got.get(a, -1) == got.get(b, -2) for a, b in want) >= 0.93 * len(want)
    assert got.items() <= groups(want).items()


def test_many_near_copies(spark):
    base = prose(7, 400).split()
    rows = [(i, " ".join(base[:200] + [f"copy{i}"] + base[200:])) for i in range(1500)] + [(5000, prose(8, 400))]
    got = {r.doc_id: r.group_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(1500)}


def test_odd_rows(odd, none):
    got = {r.doc_id: (r.group_id, r.similarity) for r in B.near_duplicates(odd).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0)}
    kept = B.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 7, 8, 9]
    assert B.near_duplicates(none).count() == 0 and B.deduplicate(none).count() == 0


def test_short_texts_and_blank_ones(spark):
    rows = [(1, "one"), (2, "One!"), (3, "two"), (4, ""), (5, ""), (6, "..."), (7, "!!!"), (8, "..."), (9, "one one one one"), (10, None)]
    got = {r.doc_id: r.group_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4, 6: 6, 8: 6}
