from collections import Counter

import numpy as np

from arcweave.llm import compact_windows as C
from arcweave.llm import shared_tokens as S


def test_edited_passages_behind_fragments(spark):
    """Earlier documents hold every token of a passage, and none holds the passage."""
    rng, rows = np.random.default_rng(8), []
    unique = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    for c in range(20):
        p = unique(60)
        q = [w if k not in (15, 31, 47) else "other" for k, w in enumerate(p)]
        for k, part in enumerate([p[:20], p[10:30], p[20:40], p[30:50], p[40:], p, q]):
            rows.append((10 * c + k, " ".join(unique(40) + part + unique(40))))
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} >= {(10 * c + 6, 10 * c + 5) for c in range(20)}
    assert all((r.class_doc_id, r.doc_id // 10) == (10 * (r.doc_id // 10) + 5, r.other_doc_id // 10) for r in got)


def test_similar_windows_keep_a_common_token():
    rng, width, needed = np.random.default_rng(9), 8, 5
    for _ in range(60):
        docs = [rng.integers(0, 25, rng.integers(8, 30)).tolist() for _ in range(5)]
        many = Counter(t for d in docs for t in set(d))
        rows = [(i, p, many[t] << 50 | t) for i, d in enumerate(docs) for p, t in enumerate(d) if many[t] > 1]
        doc, pos, key = (np.array(x) for x in zip(*rows))
        on = S.kept(doc, pos, key.astype(np.uint64), width, needed, 7)
        held = [{(int(p), int(k)) for p, k in zip(pos[on & (doc == i)], key[on & (doc == i)])} for i in range(5)]
        for b in range(5):
            for a in range(b):
                for i in range(len(docs[b]) - width + 1):
                    for j in range(len(docs[a]) - width + 1):
                        if sum((Counter(docs[b][i : i + width]) & Counter(docs[a][j : j + width])).values()) >= needed:
                            x, y = ({k for p, k in held[d] if s <= p < s + width} for d, s in ((b, i), (a, j)))
                            assert x & y


def test_similar_windows_keep_a_common_element():
    rng, width, needed = np.random.default_rng(14), 8, 5
    for trial in range(60):
        docs = [np.repeat(rng.integers(0, 25, 30), rng.integers(1, 6 if trial % 2 else 2, 30))[: rng.integers(8, 30)].tolist() for _ in range(5)]
        many = Counter(t for d in docs for t in set(d))
        doc, pos, key = (np.array(x) for x in zip(*[(i, p, many[t] << 50 | t) for i, d in enumerate(docs) for p, t in enumerate(d) if many[t] > 1]))
        rows = list(zip(*(c.tolist() for c in S.elements(doc, pos, key.astype(np.uint64), width, needed, 7))))
        for b in range(5):
            for a in range(b):
                for i in range(len(docs[b]) - width + 1):
                    for j in range(len(docs[a]) - width + 1):
                        if sum((Counter(docs[b][i : i + width]) & Counter(docs[a][j : j + width])).values()) >= needed:
                            x, y = ({r[0]: r for r in rows if r[1] == d and r[2] <= s <= r[3]} for d, s in ((b, i), (a, j)))
                            assert x.keys() & y.keys()
    twice = S.elements(np.zeros(4, np.int64), np.array([0, 0, 1, 1]), np.full(4, 2 << 50 | 7).astype(np.uint64), 3, 2)
    assert len(twice[0]) == 3 and set(twice[3].tolist()) == {1}  # a document of several rows: all that its tokens allow


def test_runs_of_a_word_are_one_class_without_all_pairs(spark):
    """The first document with a run's token holds too little of it to be similar to the others, which are all similar."""
    rng = np.random.default_rng(15)
    unique = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    inner = [(0, ["rye"] * 30 + ["hops"] * 30), *[(k, ["rye"] * 60) for k in range(1, 41)], *[(k, ["hops"] * 60) for k in range(50, 100)]]
    got = C.repeated_passages(spark.createDataFrame([(k, " ".join(unique(30) + x + unique(30))) for k, x in inner], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_doc_id) for r in got} == {(k, 1) for k in range(2, 41)} | {(k, 50) for k in range(51, 100)}
    assert len(got) < 3 * len(inner)


def test_packed_tokens_come_back():
    rng = np.random.default_rng(10)
    doc, pos, key = rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(0, 1 << 31, 300), rng.integers(0, 1 << 40, 300).astype(np.uint64)
    for size in (5, 8):
        assert all(np.array_equal(x, y) for x, y in zip(S.unpack(S.pack(doc, pos, key, size), 300, size), (doc, pos, key)))


def test_windows_that_the_greedy_comparison_leaves():
    x = np.arange(100)
    y = np.concatenate([np.arange(200, 240), x[20:66], np.arange(300, 320)])
    assert C._left(x, y, [], 46, 31, 0.5)[0][2] >= 0.5 and C._left(x, y, [(40, 60)], 46, 31, 0.5) == []


def test_left_windows_as_by_all_pairs():
    rng = np.random.default_rng(13)
    for _ in range(40):
        tb, ta = rng.integers(0, 40, 60), rng.integers(0, 40, 50)
        tb[20:32] = ta[10:22]
        got, end, want = C._left(tb, ta, [], 12, 8, 0.5), 0, []
        for i in range(len(tb) - 11):
            both = [sum((Counter(tb[i : i + 12].tolist()) & Counter(ta[j : j + 12].tolist())).values()) for j in range(len(ta) - 11)]
            j = next((j for j, n in enumerate(both) if n >= 8 and n >= 0.5 * (24 - n)), None)
            if i >= end and j is not None:
                want.append((i, j, both[j] / (24 - both[j])))
                end = i + 12
        assert got == want
