"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here, field by field; from it come the normaliser (compiled character map, white space
rules), the metaspace marker, the scored pieces (unigram) or merges in order of score (BPE) and byte fallback. Encoding
runs in multithreaded batches; decoding joins the pieces' bytes from a table.

No piece of the usual models continues a word after its marker, so BPE merges never cross the start of a word: texts are
then split there, which changes no id and lets the library's cache work. Where a piece does (checked), nothing is split.
Distinct words are told apart by their bytes, never by a hash alone.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import textnum, util

MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Bytes of words and ids that a task keeps from one run of texts to the next; it starts afresh beyond that, and at its end.
CACHED = 32 << 20
MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: (number, varint or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


class Model(NamedTuple):
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool


def parse(data: bytes) -> Model:
    """The parts of a serialized model that encoding needs."""
    pieces, scores, kinds = [], [], []
    trainer, normal = {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f.get(1, b"").decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models can be rebuilt")
    return Model(pieces, scores, kinds, kind == 2, bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)), bool(trainer.get(24, 0)))


def _merges(m: Model) -> list[tuple[str, str]]:
    ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER, UNUSED)}
    out = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                out.append((-m.scores[i], ids[p[:k]], ids[p[k:]], p[:k], p[k:]))
    return [x[3:] for x in sorted(out)]


def splits(m: Model) -> bool:
    """Whether ids can't depend on what stands before a word's marker."""
    return m.escape and not m.suffix and not any(MARK in p.lstrip(MARK) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER, UNUSED))


def build(m: Model):
    """A tokenizers.Tokenizer that gives the ids of the SentencePiece model."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    unknown = m.kinds.index(UNKNOWN)
    if m.bpe:
        model = models.BPE({p: i for i, p in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unknown, m.byte_fallback)
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if m.escape else " "
    if m.dummy_prefix and not m.suffix:
        steps.append(normalizers.Prepend(space))
    if m.dummy_prefix and m.suffix:
        steps.append(normalizers.Replace(Regex("(?<=.)$"), space))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if splits(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    users = [AddedToken(p, normalized=True) for p, k in zip(m.pieces, m.kinds) if k == USER]
    if users:
        t.add_tokens(users)
    t.encode_special_tokens = True
    return t


def bare(m: Model, joined: bool = False):
    """The rebuilt model without its normaliser, for words that bring their markers; joined: each marker begins a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(build(m).model)
    t.encode_special_tokens = True
    if joined:
        t.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
    return t


class Piece:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        m = self.model = parse(data)
        self.joined = bare(m, True)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = splits(m) and m.bpe and m.dummy_prefix and not m.charsmap and not m.squeeze and USER not in m.kinds
        self.forget()
        table = [self._bytes(p, k) for p, k in zip(m.pieces, m.kinds)]
        self.length = np.array([len(b) for b in table])
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return (piece.replace(MARK, " ") if self.model.escape else piece).encode()

    @cached_property
    def plain(self):
        """For words of several spaces."""
        return bare(self.model)

    @cached_property
    def tokenizer(self):
        """For whole texts; seldom needed where words can be told apart."""
        return build(self.model)

    @staticmethod
    def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(rows), np.int32, off[-1]), off

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row pointers)."""
        data, offsets = textnum.buffers(texts)
        marked = len(data) > 2 and bool(((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any())
        if not self.by_word or marked:
            return self._flat([e.ids for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)])
        return self._by_word(data, offsets)

    def parity(self, texts: list[str], ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which texts have the ids that the original library gives to them, whole."""
        theirs, ends = self._flat(self.original.encode(texts, num_threads=1))
        out = np.diff(ends) == np.diff(rows)
        for i in np.flatnonzero(out):
            out[i] = np.array_equal(ids[rows[i] : rows[i + 1]], theirs[ends[i] : ends[i + 1]])
        return out

    def forget(self) -> None:
        """Known words: the position of each, and by position its ids."""
        self.known: dict[bytes, int] = {}
        self.kept = 0
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, ends = self._ids([k.decode() for k in new])
        self.known.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        self.kept += sum(map(len, new)) + 4 * len(ids) + 150 * len(new)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row pointers) of words with their spaces. Words of one space are encoded many at once: the pieces tell by
        their bytes where a word ends, as long as none is unknown."""
        if self.model.byte_fallback and not any(w.startswith("  ") for w in words):
            runs = [words[i : i + 4096] for i in range(0, len(words), 4096)]
            codes = [e.ids for e in self.joined.encode_batch_fast(["".join(r).replace(" ", MARK) for r in runs], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(codes), np.int32)
            ends = np.cumsum([len(w.encode()) for w in words])
            at = np.cumsum(self.length[ids])
            cut = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[cut] == ends).all():
                return ids, np.concatenate([[0], cut + 1])
        return self._flat([e.ids for e in self.plain.encode_batch_fast([w.replace(" ", MARK) for w in words], add_special_tokens=False)])

    def _by_word(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every distinct word (spaces and what follows them) is encoded once."""
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = True
        start = np.flatnonzero(first)
        rows = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)]).dictionary_encode()
        leads = np.zeros(len(start), bool)
        leads[np.searchsorted(start, heads)] = True  # these get one more marker
        which = words.indices.to_numpy() * 2 + leads
        there = np.zeros(2 * len(words.dictionary), bool)
        there[which] = True
        code, which = np.flatnonzero(there), (np.cumsum(there) - 1)[which]
        keys = words.dictionary.take(pa.array(code // 2)).to_pylist()
        keys = [b" " + k if lead else k for k, lead in zip(keys, (code % 2).tolist())]
        if self.kept > CACHED:
            self.forget()
        several = lambda k: k.startswith(b"  ")
        new = [k for k in keys if k not in self.known]
        for some in ([k for k in new if not several(k)], [k for k in new if several(k)]):
            for at in range(0, len(some), 1 << 16):
                self._learn(some[at : at + (1 << 16)])
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        n = np.diff(self.ends)[place]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(to[-1]) + np.repeat(self.ends[:-1][place] - to[:-1], n)]
        return ids, to[rows]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """Texts of rows of ids; bytes that are no UTF-8 become U+FFFD."""
        n = self.length[ids]
        to = np.concatenate([[0], np.cumsum(n)])
        data = self.bytes[np.arange(to[-1]) + np.repeat(self.start[ids] - to[:-1], n)]
        begin, end = to[rows[:-1]], to[rows[1:]]
        if self.model.dummy_prefix:
            full = np.flatnonzero(end > begin)
            edge = begin if not self.model.suffix else end - 1
            cut = full[data[edge[full]] == 32]
            if self.model.suffix:
                end[cut] -= 1
            else:
                begin[cut] += 1
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())], pa.string())


@lru_cache(4)
def load(path: str) -> Piece:
    return Piece(path)


def _encode(path: str, threads: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()), ("parity", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        p = load(path)
        for batch in batches:
            for part in textnum.pieces(batch, "text", 1 << 20):
                texts = part.column(1)
                null, plain = np.asarray(texts.is_null()), texts.fill_null("").to_pylist()
                ids, rows = p.encode(texts)
                equal = np.array([a == b for a, b in zip(p.decode(ids, rows).to_pylist(), plain)], bool)
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
                cols = [pa.array(c, mask=null) for c in (np.diff(rows).astype(np.int32), equal, p.parity(plain, ids, rows))]
                yield pa.RecordBatch.from_arrays([part.column(0), cols[0], lists, *cols[1:]], schema=schema)
        p.forget()
        textnum.give_back()

    return run


def encode_documents(documents: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip, parity) for every row. round_trip: decoding gives the text again; parity: the
    original library gives the whole text the same ids, tried for every text.

    Defined results. A null text has nulls; an empty one no ids; a null doc_id stays null; repeated rows repeat. Very long
    texts, and words of any length, are encoded whole, in one task. There are no ties. Strings that look like special
    tokens are ordinary text. Other columns are not read, so their names can't clash. An empty table gives an empty result."""
    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(model, threads), "doc_id long, n_tokens int, ids array<int>, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encode_documents' (doc_id, ids); null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(1)
                lists = [x or [] for x in ids.to_pylist()]
                text = p.decode(*Piece._flat(lists)).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t for x, t in zip(ids.to_pylist(), text)], pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
