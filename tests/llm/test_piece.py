import struct

import pytest
import sentencepiece

from arcweave.llm import piece as P
from tests.conftest import SMALL

TEXTS = ["Hello world", "  two  spaces ", "", " ", "tabs\tand\nlines\r\n", "日本語 émoji 🙂🙃", "a" * 3000, "▁marker ▁▁", "<s> </s> <unk> <0x41>", "MiXeD 12345 ½ ﬁ", " nbsp　", "x\x00y", " lead", "trail "]


def test_ids_are_the_originals():
    p = P.load(P.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    import pyarrow as pa

    ids, rows = p.encode(pa.array(TEXTS))
    same = p.parity(TEXTS, ids, rows)
    for i, t in enumerate(TEXTS):
        mine = ids[rows[i] : rows[i + 1]].tolist()
        assert bool(same[i]) == (mine == sp.encode(t)), t
        if same[i]:
            assert p.decode(ids[rows[i] : rows[i + 1]], __import__("numpy").array([0, len(mine)])).to_pylist() == [sp.decode(mine)], t
    plain = [i for i, t in enumerate(TEXTS) if "▁" not in t]
    assert all(same[i] for i in plain)


def test_documents_agree_and_come_back(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in P.encode_documents(docs).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for r in docs.collect():
        g = got[r.doc_id]
        assert g.ids == sp.encode(r.text) and g.n_tokens == len(g.ids) and g.parity and g.round_trip
    back = {r.doc_id: r.text for r in P.decode_documents(P.encode_documents(docs)).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(spark, odd, none):
    rows = P.encode_documents(odd).collect()
    assert len(rows) == odd.count() and all((r.ids is None) == (r.n_tokens is None) == (r.parity is None) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[4].ids is None and by[3].ids == [] and by[6].parity and by[6].round_trip and by[8].round_trip
    assert P.encode_documents(none).count() == 0 and P.decode_documents(P.encode_documents(none)).count() == 0
    assert {r.doc_id: r.text for r in P.decode_documents(P.encode_documents(odd.where("doc_id is not null"))).collect()} == {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}


def proto(number: int, value) -> bytes:
    """One protobuf field."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_models_by_hand(squeeze):
    """A unigram model written down field by field: scores, byte fallback and white-space rules."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -3.0), ("th", -4.0), ("e", -4.5), ("t", -5.0), ("h", -5.0), ("▁he", -4.2), ("ther", -4.1), ("r", -6.0), ("er", -4.4), ("▁t", -5.5))]
    data = b"".join(proto(1, proto(1, p.encode()) + proto(2, s) + proto(3, k)) for p, s, k in pieces)
    data += proto(2, proto(3, 1) + proto(35, 1)) + proto(3, proto(1, b"identity") + proto(3, 1) + proto(4, squeeze) + proto(5, 1))
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    t = P.build(P.parse(data))
    for text in ("the", "there he the", "ether é", " the  er ", "th th", "z"):
        assert t.encode(text, add_special_tokens=False).ids == sp.encode(text), text
