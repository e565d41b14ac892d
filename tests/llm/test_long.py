"""One text of 64 MB through the parts of the operators that read texts."""

import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm import bagminhash, compact_windows, piece, secret_scan, textnum, toxicity
from tests.llm.conftest import prose
from tests.llm.test_secrets import FOUND

SIZE = 64 << 20


@pytest.fixture(scope="module")
def long():
    unit = prose(1, 20_000) + " "
    text = unit * (SIZE // len(unit))
    return pa.array([text + FOUND["github_token"]]), len(unit), text.count(unit)


def test_words_and_bags(long):
    texts, _, times = long
    w = textnum.words(texts)
    assert len(w.start) == 20_000 * times + 2  # the token has an underscore
    token, count, rows = bagminhash.bags(texts)
    assert rows.tolist() == [0, len(token)] and count.sum() == len(w.start) - 1 and np.median(count) >= times - 1


def test_signature_of_large_counts(long):
    token, count, rows = bagminhash.bags(long[0])
    sig = bagminhash.signatures(token, count, rows, 160)
    assert sig.shape == (1, 160) and np.isfinite(sig).all()


def test_windows_of_a_long_text(long):
    w = textnum.words(long[0])
    g, rows = textnum.grams(w.hash(), w.rows, compact_windows.GRAM)
    row, at, left, right = compact_windows.windows(textnum.mix(g, 2), rows, 46)
    assert len(at) and (right - left + 1 >= 46).all() and right.max() == len(g) - 1
    pos, far = compact_windows.packed(at, at - left, right - at)
    assert pos.null_count == len(far) - far.null_count and far.null_count < len(far)  # some positions are beyond 23 bits or 20


def test_score_and_secret(long):
    assert [f[2] for f in secret_scan.scan(long[0][0].as_py())] == ["github_token"]
    model = toxicity.Classifier(np.sort(np.array([1, 2], np.uint32)), np.ones(2), -1.0)
    assert toxicity.logits(model, long[0]).tolist() == [-1.0]


def test_encoding_comes_back(long):
    p = piece.load(piece.MODEL)
    ids, rows = p.encode(long[0])
    assert rows.tolist() == [0, len(ids)] and p.decode(ids, rows).to_pylist() == long[0].to_pylist()
    p.forget()
