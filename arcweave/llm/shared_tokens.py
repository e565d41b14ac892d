"""Tokens by which every two similar windows of different documents can be found, exactly.

A window is `width` tokens (runs of words) in a row; two are similar if they have at least `needed` tokens in common, each as
often as both hold it. So its elements are (token, 1), (token, 2) and so on up to how often it holds the token. They are
ordered by the number of documents that hold the token, then by its hash, then from the last occurrence to the first. The
smallest element that two similar windows have in common has, in both, at least `needed` elements of tokens of more than one
document that aren't smaller. So only such elements are kept, the window's prefix (the prefix filter of exact similarity joins,
for the windows at every position), and every two similar windows keep one that both have. A phrase that many documents hold
is kept only where nearly all around it is as frequent, and one that fills a window alone only as often as makes it similar.

Tokens move once, to be counted, as 50 bits of hash with document and position, packed by columns of bytes and compressed; the
few that several documents hold move back to their documents. Equal bits of different tokens can add candidates, not lose them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import textnum, util

U = textnum.U
BUCKETS = 1024
#: Documents of a token beyond which tokens are ordered by hash alone.
MANY = (1 << 13) - 1
#: Bytes of text that are spread over the buckets at once, and rows that are held before they go back.
PIECE, HOLD = 4 << 20, 1 << 20
ROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
ROW_DDL = "bucket int, n int, data binary"


def pack(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, size: int) -> bytes:
    """Columns of bytes of the steps between documents, of positions, and of the lowest `size` bytes of keys."""
    columns = [np.diff(doc.view(U), prepend=U(0)).view(np.uint8).reshape(-1, 8), pos.astype("<u4").view(np.uint8).reshape(-1, 4), key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]]
    return pa.compress(b"".join(np.ascontiguousarray(c.T).tobytes() for c in columns), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * (12 + size), codec="zstd", asbytes=True), np.uint8).reshape(12 + size, n).T
    key = np.zeros((n, 8), np.uint8)
    key[:, :size] = flat[:, 12:]
    doc = np.cumsum(np.ascontiguousarray(flat[:, :8]).view("<u8").ravel(), dtype=U).view(np.int64)
    return doc, np.ascontiguousarray(flat[:, 8:12]).view("<u4").ravel().astype(np.int64), key.view("<u8").ravel()


def _rows(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, size: int) -> pa.RecordBatch:
    """A row for each bucket; rows of one document should stand together."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, pos, key = bucket[order], doc[order], pos[order], key[order]
    at = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1))
    spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
    data = [pack(doc[s:e], pos[s:e], key[s:e], size) for s, e in spans]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([e - s for s, e in spans], pa.int32()), pa.array(data, pa.binary())], schema=ROW)


def _spread(gram: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.pieces(batch, "text", PIECE):
                w = textnum.words(part.column(1))
                g, rows = textnum.grams(w.hash(), w.rows, gram)
                n = np.diff(rows)
                on = np.repeat(n >= width, n)
                doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)[on]
                pos = (np.arange(len(g)) - np.repeat(rows[:-1], n))[on]
                g = g[on]
                if len(g):
                    yield _rows((g >> U(54)).astype(np.uint16), doc, pos, g >> U(14) & U((1 << 40) - 1), 5)

    return run


def _by_bucket(size: int, each: Callable[..., Iterator[pa.RecordBatch]], last: Callable[[], Iterator[pa.RecordBatch]] | None = None):
    """each(bucket, doc, pos, key) of whole buckets, from rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from each(now, *(np.concatenate(c) for c in zip(*held)))
                    held = []
                now = bucket
                held.append(unpack(data, n, size))
        if held:
            yield from each(now, *(np.concatenate(c) for c in zip(*held)))
        if last:
            yield from last()
        textnum.give_back()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of more than one document, with how many: a number of 13 + 50 bits, by buckets of their documents."""
    held: list[tuple[np.ndarray, ...]] = []

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            doc, pos, key = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            yield _rows((textnum.mix(doc.view(U), 61) >> U(54)).astype(np.uint16), doc, pos[order], key[order], 8)

    def each(bucket: int, doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, key))
        doc, pos, key = doc[order], pos[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        at = np.flatnonzero(new)
        many = np.add.reduceat(other.astype(np.int64), at)
        many = np.repeat(many, np.diff(np.append(at, len(key))))
        on = many > 1
        if on.any():
            held.append((doc[on], pos[on], np.minimum(many[on], MANY).astype(U) << U(50) | U(bucket) << U(40) | key[on]))
        if sum(len(x[0]) for x in held) >= HOLD:
            yield from send()

    yield from _by_bucket(5, each, send)(batches)


def kept(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, width: int, needed: int, at_once: int = 1 << 16) -> np.ndarray:
    """Which tokens, sorted by document and position, stand in a window with `needed` tokens that aren't smaller. All of a
    document whose positions occur twice, as it has several rows."""
    n = len(key)
    out = np.zeros(n, bool)
    if not n:
        return out
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    of = np.cumsum(new) - 1
    place = of * (int(pos.max()) + width + 1) + pos
    twice = np.flatnonzero(place[1:] == place[:-1])
    key = key.astype(np.int64)
    pad_key, pad_place = np.append(key, np.zeros(width, np.int64)), np.append(place, np.full(width, place[-1] + 2 * width))
    keys, places = (np.lib.stride_tricks.sliding_window_view(x, width) for x in (pad_key, pad_place))
    least = np.zeros(n, np.int64)  # of the window that begins there, the token that has `needed` no smaller ones
    full = np.flatnonzero(pad_place[needed - 1 : needed - 1 + n] - place < width)
    for s in range(0, len(full), at_once):
        i = full[s : s + at_once]
        inside = np.where(places[i] - place[i, None] < width, keys[i], 0)
        least[i] = np.partition(inside, width - needed, 1)[:, width - needed]
    for k in range(min(width, n)):
        out[k:] |= (place[k:] - place[: n - k] < width) & (key[k:] <= least[: n - k])
    if len(twice):
        out |= np.isin(of, of[twice])
    return out


def elements(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, width: int, needed: int, at_once: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """(key, doc, low, high, start, end): the prefix elements of the windows, for tokens sorted by document and position. A window
    that has the element in its prefix starts in low..high of one of its rows, and the tokens that it holds stand in start to end;
    not all windows that start there need to have it. The key of a token's first occurrence is the token's. A document whose positions occur twice, as it has several rows, has all elements
    that its tokens allow."""
    n = len(key)
    none = np.zeros(0, U), *(np.zeros(0, np.int64),) * 5
    if not n:
        return none
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    of = np.cumsum(new) - 1
    place = of * (int(pos.max()) + width + 1) + pos
    twice = np.isin(of, of[1:][place[1:] == place[:-1]])
    first = np.where(new, 0, np.concatenate([[0], pos[:-1] + 1]))  # windows from the token before to this one hold no others
    pad_key, pad_place = np.append(key.astype(np.int64), np.zeros(width, np.int64)), np.append(place, np.full(width, place[-1] + 2 * width))
    keys, places = (np.lib.stride_tricks.sliding_window_view(x, width) for x in (pad_key, pad_place))
    reach = pad_place[needed - 1 : needed - 1 + n] - place  # how far the last of `needed` tokens is
    last = np.searchsorted(place, place + width) - 1
    full = np.flatnonzero((reach < width) & ~twice)
    found = [none]
    for s in range(0, len(full), at_once):
        i = full[s : s + at_once]
        inside = np.sort(np.where(places[i] - place[i, None] < width, keys[i], 0), 1)
        rest = np.ones(inside.shape, np.uint8)  # how many equal ones are left from there
        for j in range(width - 2, -1, -1):
            rest[:, j] += np.where(inside[:, j] == inside[:, j + 1], rest[:, j + 1], 0).astype(np.uint8)
        on = inside[:, : width - needed + 1] > 0
        at = np.repeat(i, on.sum(1))
        token, nth = inside[:, : width - needed + 1][on].view(U), rest[:, : width - needed + 1][on]
        e, row = _nth(token, nth), np.repeat(np.arange(len(i)), on.sum(1))
        order = np.argsort(textnum.mix(e, 73) << U(15) | row.astype(U))  # windows of an element in order, at_once is 15 bits at most
        e, at = e[order], at[order]
        low = np.maximum(first[at], pos[at] + reach[at] - width + 1)
        cut = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (of[at[1:]] != of[at[:-1]]) | (low[1:] > pos[at[:-1]] + width)])) if len(e) else np.zeros(0, np.int64)
        end = at[np.append(cut[1:], len(e)) - 1] if len(cut) else at
        found.append((e[cut], doc[at[cut]], low[cut], pos[end], pos[at[cut]], pos[last[end]] + 1))
    if twice.any():
        t = np.flatnonzero(twice)
        t = t[np.lexsort((key[t], of[t]))]
        fresh = np.concatenate([[True], (key[t][1:] != key[t][:-1]) | (of[t][1:] != of[t][:-1])])
        nth = np.arange(len(t)) - np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0)) + 1
        t, nth = t[nth <= width], nth[nth <= width]
        start, most = np.zeros(len(t), np.int64), np.full(len(t), int(pos[twice].max()))
        found.append((_nth(key[t], nth), doc[t], start, most, start, most + 1))
    return tuple(np.concatenate(c) for c in zip(*found))


def _nth(token: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return np.where(nth == 1, token, textnum.mix(token, 67) + textnum.mix(nth.astype(U), 71)).astype(U)


COLUMNS = ("low", "high", "start", "end")
FOUND = "key long, doc long, " + ", ".join(f"{c} int" for c in COLUMNS)


def _keep(width: int, needed: int):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), *[(c, pa.int32()) for c in COLUMNS]])

    def each(bucket: int, doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((pos, doc))
        e, d, *rest = elements(doc[order], pos[order], key[order], width, needed)
        if len(e):
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(d), *[pa.array(x.astype(np.int32)) for x in rest]], schema=schema)

    return _by_bucket(8, each)


def find(documents: DataFrame, width: int, gram: int, needed: int) -> DataFrame:
    """The elements kept, as elements() has them: any windows of two documents with `needed` common tokens have one that both
    keep, and start in low..high of a row of both."""
    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    sent = docs.mapInArrow(_spread(gram, width), ROW_DDL).repartition("bucket").sortWithinPartitions("bucket")
    back = sent.mapInArrow(_count, ROW_DDL).repartition("bucket").sortWithinPartitions("bucket")
    return back.mapInArrow(_keep(width, needed), FOUND)
