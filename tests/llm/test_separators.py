import numpy as np
import pytest

from arcweave.llm import separators as S
from tests.conftest import SMALL


def brute(tokens, sep):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == sep:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    files = {"a.tok": rng.integers(0, 4, 100), "empty.tok": [], "none.tok": [1, 2, 3], "only.tok": [0, 0, 0], "open.tok": [0, 5, 6], "long.tok": [7] * 50 + [0]}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes())
    got = {}
    for r in S.count_tokens(spark, str(tmp_path), 0, 2, block).collect():
        got.setdefault(r.file, []).append((r.position, r.start_token, r.n_tokens, r.terminated))
    want = {n: [(i, *x) for i, x in enumerate(brute(list(t), 0))] for n, t in files.items() if len(t)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_documents_get_their_own_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    enc = S.encoding(S.VOCABULARY)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in S.document_token_counts(docs).collect()) == want


def test_odd_rows(spark, odd, none, tmp_path):
    enc = S.encoding(S.VOCABULARY)
    want = sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text))) for r in odd.collect() if r.text is not None)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in S.document_token_counts(odd).collect()) == want
    assert S.document_token_counts(none).count() == 0 and S.count_tokens(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "half.tok").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole tokens"):
        S.count_tokens(spark, str(tmp_path))
