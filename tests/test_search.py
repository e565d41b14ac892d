import pytest

from arcweave import schemas
from arcweave.operators import search

TITLES = [
    ("Beyoncé", 0.01, []), ("Psychology", 0.02, []), ("The Lord of the Rings", 0.05, ["LOTR", "Lord of the rings"]), ("SoFi", 0.001, []), ("Sofia", 0.03, []), ("World War II", 0.02, ["WW2"]),
    ("War of the Worlds", 0.04, []), ("Mathematics", 0.05, []), ("A", 0.001, []), ("Apple", 0.02, []), ("World", 0.01, ["World"]),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, t, 0.0, 0.0, 1.0, i % 3, imp, a) for i, (t, imp, a) in enumerate(TITLES)], schemas.SEARCH_DOC)
    return search.build(docs)


@pytest.mark.parametrize(("query", "first"), [
    ("beyonce", "Beyoncé"), ("phsycology", "Psychology"), ("lord of the rings", "The Lord of the Rings"), ("SoFi", "SoFi"), ("world war", "World War II"), ("math", "Mathematics"), ("ww2", "World War II"),
    ("mathmatic", "Mathematics"), ("a", "A"), ("lotr", "The Lord of the Rings"), ("rings the", None), ("the", "The Lord of the Rings"),
])
def test_documented_examples(index, query, first):
    got = [r.t for r in search.search(index, query).collect()]
    if first:
        assert got[0] == first
    else:
        assert got == ["The Lord of the Rings"]


@pytest.mark.parametrize("query", ["", "  ", "!!!", "zzzzzz", "ab xyz"])
def test_nothing_found(index, query):
    assert search.search(index, query).count() == 0


def test_required_words():
    assert search.required(["lord", "of", "the", "rings"]) == [0, 3] and search.required(["of", "the"]) == [0, 1] and search.required(["lord", "of"]) == [0, 1]


def test_limits(index):
    assert [search.clamp(n) for n in (None, 0, -3, 7, 99)] == [10, 1, 1, 7, 50]
    assert search.search(index, "w", 1).count() == 1


def test_aliases_that_bring_nothing_are_dropped(index):
    held = {(r.id, r.value_no): r.value for r in index.values.collect()}
    assert held[(2, 1)] == "LOTR" and held[(2, 2)] == "Lord of the rings" and (10, 1) not in held


def test_an_index_can_be_kept(spark, index, tmp_path):
    search.write(index, str(tmp_path))
    again = search.read(spark, str(tmp_path))
    assert [tuple(r) for r in search.search(again, "world war").collect()] == [tuple(r) for r in search.search(index, "world war").collect()]


def test_bm25(index):
    got = {r.id: r.score for r in search.word_scores(index, "apple", False).collect()}
    want = search.bm25_estimate(1, 1, index.words, 1, index.n) + 1  # the word itself is within its own typos
    assert abs(got[9] - want) < 1e-9
