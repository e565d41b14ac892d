import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import compact_windows as C
from arcweave.llm import textnum
from tests.llm.conftest import plain_words, prose


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=24), min_size=1, max_size=4), st.integers(1, 6))
def test_windows_hold_every_subsequence_once(rows, width):
    values = np.array([v for r in rows for v in r], np.uint64)
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    row, at, left, right = C.windows(values, ptr, width)
    for i, r in enumerate(rows):
        mine = [(a, lo, hi) for j, a, lo, hi in zip(row, at, left, right) if j == i]
        for s in range(len(r)):
            for e in range(s + width - 1, len(r)):
                low = min(r[s : e + 1])
                assert any(lo <= s and e <= hi and r[a] == low for a, lo, hi in mine), (r, s, e, mine)
        for a, lo, hi in mine:
            assert hi - lo + 1 >= width and r[a] == min(r[lo : hi + 1])


def covered(rows, doc, s, e):
    return any(r.doc_id == doc and r.start_word <= s and r.end_word >= e for r in rows)


def test_planted_passages(spark):
    shared = [prose(500 + k, 60) for k in range(4)]
    docs, spots = [], []
    for i in range(60):
        a, b = prose(1000 + i, 80 + i), prose(2000 + i, 70)
        p = shared[i % 4]
        if i % 3 == 1:  # one word in twenty is another
            w = p.split()
            w[20], w[40] = "changed", "other"
            p = " ".join(w)
        docs.append((i, f"{a} {p} {b}"))
        spots.append((i, 80 + i, 140 + i, i % 3 == 1))
    got = C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact = [s for s in spots if not s[3] and s[0] > 4]
    assert all(covered(got, d, s, e) for d, s, e, _ in exact)
    assert {r.doc_id for r in got} >= {d for d, *_ in spots if d > 4} and all(r.similarity >= C.SIMILAR and r.other_doc_id < r.doc_id for r in got)
    words = {d: plain_words(t) for d, t in docs}
    for r in got:  # verified against the texts themselves
        x, y = words[r.doc_id][r.start_word : r.end_word], words[r.other_doc_id][r.other_start_word : r.other_end_word]
        x, y = ([tuple(w[i : i + C.GRAM]) for i in range(len(w) - C.GRAM + 1)] for w in (x, y))
        both = sum(min(x.count(t), y.count(t)) for t in set(x))
        assert min(len(x), len(y)) >= C.MIN_WORDS - C.GRAM + 1 and abs(both / (len(x) + len(y) - both) - r.similarity) < 1e-9


def test_passages_that_alternate_with_unique_text(spark):
    rng, rows = np.random.default_rng(5), []
    unique = lambda n: " ".join(f"u{k}" for k in rng.integers(0, 1 << 40, n))
    cases = [(10, 100, 60, 60), (3, 60, 50, 50), (3, 60, 50, 70), (8, 60, 0, 70)]  # passages, their words, words between in a and b
    for c, (many, words, *between) in enumerate(cases):
        shared = [unique(words) for _ in range(many)]
        rows += [(2 * c + side, " ".join(f"{p} {unique(gap)}" for p in shared)) for side, gap in enumerate(between)]
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for c, (many, words, _, gap) in enumerate(cases):
        for p in range(many):
            s = p * (words + gap)
            assert covered(got, 2 * c + 1, s, s + words), (c, p)
    assert all(r.similarity >= C.SIMILAR and r.other_doc_id == r.doc_id - 1 for r in got)


def test_partners_behind_fragments(spark):
    rng, rows = np.random.default_rng(6), []
    unique = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    for c in range(20):
        p = unique(60)
        for k, part in enumerate([p[:45], p[15:], p[5:49], p, p]):  # fragments too short for a passage come first
            rows.append((10 * c + k, " ".join(unique(30) + part + unique(30))))
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(covered([r for r in got if r.other_doc_id == 10 * c + 3], 10 * c + 4, 30, 90) for c in range(20))
    assert found >= 19


def test_sides_that_hold_tokens_unequally_often():
    x, y = (np.arange(k, k + 60, dtype=np.int32) for k in (0, 1000))
    got = C.compare(np.concatenate([x, x, x, x, y]), np.concatenate([x, y, y, y, y]))
    assert sum(e - s for s, e, *_ in got) >= 60 and all(sim >= C.SIMILAR for *_, sim in got)


def test_unrelated_documents_have_none(spark):
    docs = [(i, prose(3000 + i, 500)) for i in range(30)] + [(100, prose(1, 49)), (101, prose(1, 49))]
    assert C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_odd_rows(spark, odd, none):
    got = C.repeated_passages(odd).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.similarity) for r in got] == [(2, 0, 200, 1, 1.0)]
    assert C.repeated_passages(none).count() == 0
    runs = spark.createDataFrame([(1, "rye " * 500), (2, "rye " * 120), (3, "hops " * 100)], "doc_id long, text string")
    assert {(r.doc_id, r.other_doc_id) for r in C.repeated_passages(runs).collect()} == {(2, 1)}


def test_words_of_texts():
    import pyarrow as pa

    texts = ["The north, ROAD-runs!", None, "", "Élan vital vital", "日本 日本", "a" * 10]
    w = textnum.words(pa.array(texts))
    h = w.hash()
    got = [h[w.rows[i] : w.rows[i + 1]].tolist() for i in range(len(texts))]
    assert [len(g) for g in got] == [len(plain_words(t or "")) for t in texts]
    assert got[3][1] == got[3][2] and got[4][0] == got[4][1]
    assert textnum.words(pa.array(["élan"])).hash()[0] == got[3][0]


def test_packed_windows_come_back(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = [np.append(rng.integers(0, 1 << bits, 50), [1 << bits, 5 << bits]) for bits in C.BITS]
    pos, far = C.packed(*parts)
    df = spark.createDataFrame(pa.table({"i": np.arange(52), "pos": pos, "far": far}))
    got = df.select("i", *[C.part(k).alias(k) for k in C.PARTS]).orderBy("i").toPandas()
    assert all(got[k].tolist() == x.tolist() for k, x in zip(C.PARTS, parts)) and pos.null_count == 2
    none = C.packed(*[x[:50] for x in parts])[1]
    assert len(none.offsets) == 51 and none.null_count == 50  # the JVM reads offsets also where all are null


def test_run_marks_depend_on_whole_runs_alone():
    rng = np.random.default_rng(4)
    g = textnum.mix(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    at = np.arange(0, 200, 7)

    def marks(g, base):
        x = C.run_marks(C.run_hashes(g, 30), C.run_hashes(g, 15), at + base, np.full_like(at, base), np.full_like(at, base + 200))
        return x >> 42, x >> 21 & C.MARKS, x & C.MARKS

    after, before, around = marks(g, 0)
    assert all((x == 0) == (a + 30 >= 200) for a, x in zip(at, after)) and all((x == 0) == (a < 30) for a, x in zip(at, before))
    assert all((x == 0) == (a < 15 or a + 15 >= 200) for a, x in zip(at, around))
    assert all(np.array_equal(x, y) for x, y in zip((after, before, around), marks(np.concatenate([textnum.mix(g[:50] + textnum.U(9)), g]), 50)))
    other = g.copy()
    other[100] += textnum.U(1)  # one token changes the marks of the runs that hold it, and no others
    for x, y, low, high in zip((after, before, around), marks(other, 0), (1, -30, -15), (30, -1, 15)):
        assert all((p == q) == (not p or not (a + low <= 100 <= a + high) or (low < 0 < high and a == 100)) for a, p, q in zip(at, x, y))


def test_a_set_phrase_in_many_surroundings_is_no_square(spark):
    """A phrase of 20 words in 400 documents, between two real repeats: those are found, and few pairs meet."""
    rng, rows = np.random.default_rng(11), []
    unique = lambda n: " ".join(f"u{k}" for k in rng.integers(0, 1 << 40, n))
    phrase, around = unique(20), [unique(30) for _ in range(4)]
    for i in range(400):
        a, b = (around[:2], around[2:])[i > 200] if i in (100, 300, 350, 399) else (unique(30), unique(30))
        rows.append((i, f"{unique(40)} {a} {phrase} {b} {unique(40)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} >= {(350, 300), (399, 300)} or {(350, 300), (399, 350)} <= {(r.doc_id, r.other_doc_id) for r in got}
    met = C.meet_heads(C.seats(docs), C.MIN_WORDS - C.GRAM + 1).count()
    assert met < 400 * C.HASHES * 12


def test_coverage_of_repeated_word_runs(spark):
    """Of all runs of 50 words that stand in an earlier document too, at least 99 in 100 are covered."""
    from tests.conftest import SMALL

    rows = sorted((r.doc_id, plain_words(r.text)) for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").collect())
    seen, want = set(), []
    for d, w in rows:
        runs = [hash(tuple(w[i : i + 50])) for i in range(len(w) - 49)]
        want += [(d, i) for i, r in enumerate(runs) if r in seen]
        seen.update(runs)
    held = {}
    for r in C.repeated_passages(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")).collect():
        held.setdefault(r.doc_id, []).append((r.start_word, r.end_word))

    def inside(d, i):
        at = i
        for s, e in sorted(held.get(d, [])):  # passages that touch cover together
            if s <= at < e:
                at = e
        return at >= i + 50

    assert sum(inside(d, i) for d, i in want) >= 0.99 * len(want) > 1000
