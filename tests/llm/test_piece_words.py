"""Words that a hash might confuse, words of any length, and what parity says."""

import pyarrow as pa
import pytest
import sentencepiece

from arcweave.llm import piece as P
from arcweave.llm import textnum
from tests.llm.conftest import prose


def thue_morse(n: int) -> tuple[str, str]:
    """Two strings that collide under every polynomial hash modulo 2**64."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x[:n], x[:n].translate(str.maketrans("ab", "ba"))


def same(p, texts) -> bool:
    """Whether the ids are the original's, found here and by parity()."""
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    ids, rows = p.encode(pa.array(texts))
    plain = [t or "" for t in texts]
    return [ids[i:j].tolist() for i, j in zip(rows[:-1], rows[1:])] == sp.encode(plain) and p.parity(plain, ids, rows).all()


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words(n):
    a, b = thue_morse(n)
    assert same(P.load(P.MODEL), [a, b, f"x {a}", f"x {b}"])
    assert len(set(textnum.words(pa.array([a, b])).hash().tolist())) == 2


def test_words_of_a_megabyte_and_runs_of_spaces():
    assert same(P.Piece(P.MODEL), ["ab" * 300_000, "one   two    three", "   ", prose(3, 40_000), "", None, "  x"])


def test_starting_afresh_changes_nothing(monkeypatch):
    p = P.Piece(P.MODEL)
    texts = [pa.array([prose(k, 300)]) for k in range(6)]
    want = [p.encode(t)[0].tolist() for t in texts]
    monkeypatch.setattr(P, "CACHED", 0)
    assert [p.encode(t)[0].tolist() for t in texts] == want and p.kept < 1 << 20


def test_parity_can_fail(monkeypatch):
    """With another model as the original, parity is false."""
    p = P.Piece(P.MODEL)

    class Other:
        def encode(self, texts, **_):
            return [[1, 2, 3] * bool(t) for t in texts]

    p.original = Other()
    monkeypatch.setattr(P, "load", lambda _: p)
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["old mills and farms", None, ""])})
    out = pa.Table.from_batches(list(P._encode(P.MODEL, 1)(iter([batch])))).to_pylist()
    assert [r["parity"] for r in out] == [False, None, True] and [r["ids"] is None for r in out] == [False, True, False]
