"""Substring near-duplicates: passages of at least MIN_WORDS words that are similar to passages of earlier documents.

The token sequence of a document is its runs of GRAM words. Candidates come from shared_tokens: documents that keep a common
element of windows, which any similar windows of MIN_WORDS words do. Each document is compared with the first one of each of its
elements, as a whole between its first and last window with one. Accepted passages that overlap in a document make one stretch of
it, and stretches that passages connect make a class. Then all other pairs of documents that keep an element are compared, unless
the windows with it overlap passages of one class in both: such links are those of the class, so that copies aren't expanded into
all pairs. Where passages don't hold all of these windows that other documents hold, documents are compared with one more partner,
the first such one. So any two similar windows of two documents overlap passages of one class, or their documents were compared.

windows(), seats() and meet_heads() are the candidates by min-hash of before, which miss links; the query doesn't use them. For
each of HASHES hash functions, all subsequences of at least MIN_WORDS words fall into few compact windows (left, centre, right):
whatever starts in left..centre and ends in centre..right has its min-hash at centre.

Defined results. Null text or null doc_id, empty texts and texts under MIN_WORDS words: no rows. Rows that repeat a
doc_id count as one document (one with itself is no pair), so a passage repeated only inside one document is not
reported. A very long text is one row of one task. An empty table gives an empty result. Other columns are
not read, so their names can't clash. The first document of a token is
the one with the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.llm import shared_tokens, textnum, util

MIN_WORDS = 50
GRAM = 5
HASHES = 6
ENOUGH = 2
SIMILAR = 0.5
#: Tokens of a run: with the centre 31, of the 46 of the shortest passage, which makes a similarity of a half.
RUN = 30
#: Words whose tokens are compared in one go.
AT_ONCE = 1 << 18


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width]; x has at least width entries. Doubles the width, so it takes log2(width) passes."""
    span, out = 1, x
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def windows(values: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Compact windows of at least `width` tokens in each row: (row, at, left, right), ends included, positions within the
    row. Equal values that share a window give it once."""
    none = (np.zeros(0, np.int64),) * 4
    if len(values) < width:
        return none
    n = np.diff(rows)
    starts = len(values) - width + 1
    low = _slide(values, width, np.minimum)
    fits = np.zeros(len(values) + 1, np.int32)
    has = n >= width
    np.add.at(fits, rows[:-1][has], 1)
    np.add.at(fits, rows[1:][has] - width + 1, -1)
    low = np.where(np.cumsum(fits)[:starts] > 0, low, 0)
    pad = np.zeros(width - 1, low.dtype)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), width, np.maximum) == values)
    if not len(chosen):
        return none
    row = np.searchsorted(rows, chosen, "right") - 1
    v, m = values[chosen], len(chosen)

    def nearest(step: int) -> np.ndarray:
        """The nearest chosen position with a smaller value in that direction, or one that is out of the row."""
        p = np.arange(m) + step
        todo = np.arange(m)
        while len(todo):
            q = p[todo]
            ok = (q >= 0) & (q < m)
            ok[ok] = (row[q[ok]] == row[todo[ok]]) & (v[q[ok]] >= v[todo[ok]])
            todo = todo[ok]
            p[todo] = p[p[todo]]
        return p

    before, after = nearest(-1), nearest(1)
    i = np.arange(m)
    left, right = rows[row].copy(), rows[row + 1] - 1
    ok = (before >= 0) & (row[np.maximum(before, 0)] == row)
    left[ok] = chosen[before[ok]] + 1
    ok = (after < m) & (row[np.minimum(after, m - 1)] == row)
    right[ok] = chosen[after[ok]] - 1
    order = np.lexsort((i, left, v, row))
    same = np.zeros(m, bool)
    a, b = order[1:], order[:-1]
    same[a] = (row[a] == row[b]) & (v[a] == v[b]) & (left[a] == left[b])
    keep = ~same & (right - left + 1 >= width)
    base = rows[row[keep]]
    return row[keep], chosen[keep] - base, left[keep] - base, right[keep] - base


BITS = (23, 20, 20)
MARKS = (1 << 21) - 1
PARTS = ("at", "before", "after")
SIDES = ("run_after", "run_before", "run_around")


def packed(*parts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(pos, far): at, before and after in one number of 23 + 20 + 20 bits, which moves a window in two thirds of the bytes;
    far has those that don't fit, where pos is null."""
    parts = [x.astype(np.int64) for x in parts]
    pos, big = np.zeros(len(parts[0]), np.int64), np.zeros(len(parts[0]), bool)
    for x, bits in zip(parts, BITS):
        pos = pos << bits | x
        big |= x >> bits != 0
    flat = np.stack([x[big] for x in parts], 1).ravel().astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(big)]).astype(np.int32) * len(parts)  # also where all are null: the JVM reads them
    return pa.array(pos, mask=big), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~big))


def part(name: str, pos: str = "pos", far: str = "far") -> Column:
    """One of PARTS of a packed window."""
    i = PARTS.index(name)
    return F.expr(f"cast(coalesce(shiftright({pos}, {sum(BITS[i + 1 :])}) & {(1 << BITS[i]) - 1}L, get({far}, {i})) AS int)")


def run_hashes(g: np.ndarray, n: int) -> np.ndarray:
    """A hash of g[i : i + n] for each i, whatever stands beyond the last in it: hashes of halves that may overlap."""
    out, have = textnum.mix(g, 51), 1
    while have < n:
        step = min(have, n - have)
        out = textnum.mix(out * textnum.U(textnum._P) + np.concatenate([out[step:], np.zeros(min(step, len(out)), textnum.U)]), 53 + have)
        have += step
    return out


def run_marks(long: np.ndarray, short: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Three marks of 21 bits in one number, of the runs after, before and around each position of rows low to high; 0 for a
    run that goes beyond its row. long and short are run_hashes of RUN and of half of it."""
    half = RUN // 2
    spot = lambda x, i: x[np.clip(i, 0, max(0, len(x) - 1))]
    around = textnum.mix(spot(short, at - half) * textnum.U(textnum._P) + spot(short, at + 1), 59)
    out = np.zeros(len(at), np.int64)
    for h, there in ((spot(long, at + 1), high - at > RUN), (spot(long, at - RUN), at - low >= RUN), (around, (high - at > half) & (at - low >= half))):
        out = out << 21 | np.where(there, h % textnum.U(MARKS) + textnum.U(1), textnum.U(0)).astype(np.int64)
    return out


def _signatures(gram: int, hashes: int, width: int):
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("far", pa.list_(pa.int32())), ("runs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.pieces(batch, "text"):
                w = textnum.words(part.column(1))
                g, rows = textnum.grams(w.hash(), w.rows, gram)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                long, short = run_hashes(g, RUN), run_hashes(g, RUN // 2)
                out = []
                for k in range(hashes):
                    f = textnum.mix(g, k + 2)
                    row, at, left, right = windows(f, rows, width)
                    h = f[rows[row] + at] & textnum.U(0xFFFFFFFFFFFFFFF0) | textnum.U(k)
                    out.append((h.view(np.int64), ids[row], run_marks(long, short, rows[row] + at, rows[row], rows[row + 1]), at, at - left, right - at))
                h, doc, runs, *rest = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc, pa.int64()), *packed(*rest), pa.array(runs)], schema=schema)

    return run


def seats(documents: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hashes: int = HASHES) -> DataFrame:
    """(h, doc, at, before, after, SIDES, ranks, heads): the windows that share a min-hash with another document; the marks of
    their runs and their ranks among those that also share a run's, in the order of documents and positions; and the first
    windows with the min-hash, and with each mark. One shuffle by min-hash serves all these orders."""
    if not 1 <= hashes <= 16 or not gram <= min_words:
        raise ValueError("1 to 16 hash functions, and passages of at least one token")
    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    found = docs.mapInArrow(_signatures(gram, hashes, min_words - gram + 1), "h long, doc long, pos long, far array<int>, runs long")
    by = lambda *keys: Window.partitionBy(*keys).orderBy("doc", "pos", "far")
    head = lambda *keys: F.first(F.struct("doc", "pos", "far", "runs")).over(by(*keys))
    held = found.withColumns({"first": head("h"), "next": F.lead("doc").over(by("h"))}).where("first.doc <> doc or next is not null")
    held = held.withColumns(_runs("runs"))
    for k in SIDES:
        there = F.col(k) > 0  # of a run that isn't whole, another is
        held = held.withColumns({f"rank_{k}": F.when(there, F.row_number().over(by("h", k)) - 1).otherwise(0), f"first_{k}": F.when(there, head("h", k)).otherwise(F.col("first"))})
    heads = F.array_distinct(F.array("first", *[f"first_{k}" for k in SIDES])).alias("heads")
    return held.select("h", "doc", *[part(k).alias(k) for k in PARTS], *SIDES, *[f"rank_{k}" for k in SIDES], heads)


def _runs(runs: str) -> dict[str, Column]:
    return {k: F.expr(f"cast(shiftright({runs}, {42 - 21 * i}) & {MARKS} AS int)") for i, k in enumerate(SIDES)}


def _met(pairs: DataFrame, width: int) -> DataFrame:
    """(b, a, k, at, shift, before, after) of windows (h, doc, at, before, after) and their partners (p_...): what both have
    around their min-hash, where that is at least `width` tokens. k has a bit for the function and one for a common run."""
    return pairs.where("p_doc <> doc").select(
        F.col("doc").alias("b"), F.col("p_doc").alias("a"), F.expr("cast(shiftleft(1, cast(h & 15 as int)) as int) | if(same, 65536, 0)").alias("k"), "at", (F.col("at") - F.col("p_at")).alias("shift"),
        F.least("before", "p_before").alias("before"), F.least("after", "p_after").alias("after"),
    ).where(F.col("before") + F.col("after") + 1 >= width)


def meet_heads(windows: DataFrame, width: int) -> DataFrame:
    """Windows with the first ones that share their min-hash, or also a run."""
    pairs = windows.select("h", "doc", "at", "before", "after", *SIDES, F.explode("heads").alias("p"))
    same = F.lit(False)
    for k, v in _runs("p.runs").items():
        same = same | ((F.col(k) > 0) & (F.col(k) == v))
    return _met(pairs.select("*", F.col("p.doc").alias("p_doc"), same.alias("same"), *[part(k, "p.pos", "p.far").alias("p_" + k) for k in PARTS]), width)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, regions) -> the words of each region as 32-bit hashes."""
    schema = pa.schema([("doc", pa.int64()), ("region", pa.int32()), ("words", pa.list_(pa.int32()))])
    for batch in batches:
        for part in textnum.pieces(batch, "text"):
            w = textnum.words(part.column(1))
            h = (w.hash() >> textnum.U(32)).astype(np.uint32).view(np.int32)
            docs, regions, words = [], [], []
            for i, (doc, spans) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                row = h[w.rows[i] : w.rows[i + 1]]
                for s in spans:
                    docs.append(doc)
                    regions.append(s["s"])
                    words.append(row[s["s"] : s["e"]])
            off = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int32)
            flat = np.concatenate(words) if words else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(regions, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], schema=schema)


def _best(hit: np.ndarray) -> tuple[int, int]:
    """Bounds of the run with the most hits over misses."""
    c = np.concatenate([[0], np.cumsum(np.where(hit, 1, -1))])
    low = np.minimum.accumulate(c)
    end = int(np.argmax(c - low))
    return int(np.argmin(c[: end + 1])), end


def _jaccard(x: np.ndarray, y: np.ndarray, size: int) -> float:
    x, y = np.bincount(x, minlength=size), np.bincount(y, minlength=size)
    return np.minimum(x, y).sum() / np.maximum(x, y).sum()


def _gap(miss: np.ndarray) -> tuple[int, int]:
    """Bounds of the longest stretch of misses; equal where there is none."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], miss, [False]]).astype(np.int8)))
    if not len(edge):
        return 0, 0
    i = 2 * int(np.argmax(edge[1::2] - edge[::2]))
    return int(edge[i]), int(edge[i + 1])


def _common(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch that stands in both: (start in x, start in y, length), by bisection over its length. Stretches
    of a power of two have numbers, equal for equal ones, made from those of their halves; any length is two of these."""
    n, both = len(x), np.concatenate([x, y])
    names = [np.unique(both, return_inverse=True)[1].astype(np.int64)]
    while 2 << len(names) - 1 <= min(len(x), len(y)):
        half, size = names[-1], 1 << len(names) - 1
        names.append(np.unique(half[:-size] * (half.max() + 1) + half[size:], return_inverse=True)[1].astype(np.int64))

    def at(length: int) -> tuple[int, int] | None:
        k = length.bit_length() - 1
        name, over = names[k], length - (1 << k)
        code = name[: len(both) - length + 1] * (name.max() + 1) + name[over : over + len(both) - length + 1]
        _, i, j = np.intersect1d(code[: n - length + 1], code[n:], return_indices=True)
        return (int(i[0]), int(j[0])) if len(i) else None

    low, high, best = 0, min(len(x), len(y)), (0, 0)
    while low < high:
        mid = (low + high + 1) // 2
        if spot := at(mid):
            low, best = mid, spot
        else:
            high = mid - 1
    return *best, low


def _needed(least: int, similar: float) -> int:
    """Tokens that two passages of at least `least` tokens have in common if they are similar: J = m / (x + y - m)."""
    return int(np.ceil(2 * least * similar / (1 + similar) - 1e-9))


def _overlaps(words: list[np.ndarray], offsets: list[np.ndarray], gram: int) -> np.ndarray:
    """For each pair of word lists, how many tokens they have in common: no passages within them have more."""
    n, keys, pair = len(offsets[0]) - 1, [], []
    for w, off in zip(words, offsets):
        g, rows = textnum.grams(textnum.mix(w[off[0] : off[-1]].astype(np.int64).view(textnum.U)), (off - off[0]).astype(np.int64), gram)
        of = np.repeat(np.arange(n), np.diff(rows))
        keys.append(textnum.mix(g ^ textnum.mix(of.astype(textnum.U), 19)))
        pair.append(of)
    found, at, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    x, y = (np.bincount(k, minlength=len(found)) for k in np.split(group, [len(keys[0])]))
    return np.bincount(np.concatenate(pair)[at], np.minimum(x, y), n)


def _left(tb: np.ndarray, ta: np.ndarray, out: list[tuple[int, int]], least: int, needed: int, similar: float) -> list[tuple[int, int, float]]:
    """Windows of `least` tokens of tb outside the ranges `out` that are similar to one of ta: (start, start in ta, similarity),
    by trying every pair that has enough tokens in common."""
    if min(len(tb), len(ta)) < least:
        return []
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[[np.arange(len(x) - least + 1), np.arange(least, len(x) + 1)]], axis=0)[0]
    free = np.isin(tb, ta)
    taken = np.zeros(len(tb), bool)
    for s, e in out:
        taken[s:e] = True
    found, end = [], 0
    size = int(max(tb.max(), ta.max())) + 1
    gain = np.concatenate([[0], np.cumsum(np.bincount(ta, minlength=size)[tb])]).tolist()
    last, lack = 0, 0  # where windows of ta were counted, and how many tokens the best one lacked: so many have to come in
    for i in np.flatnonzero((sums(free) >= needed) & (sums(taken) == 0)).tolist():
        if i < end or gain[i + least] - gain[last + least] < lack:
            continue
        marked = np.zeros(size, bool)
        marked[tb[i : i + least]] = True
        c = np.concatenate([[0], np.cumsum(marked[ta])])
        last, lack = i, needed - int((c[least:] - c[:-least]).max())
        if lack > 0:
            continue
        own, x = np.unique(tb[i : i + least], return_counts=True)
        spot = np.minimum(np.searchsorted(own, ta), len(own) - 1)
        there = own[spot] == ta
        for j in np.flatnonzero(sums(there) >= needed).tolist():
            both = np.minimum(x, np.bincount(spot[j : j + least][there[j : j + least]], minlength=len(own))).sum()
            if both >= similar * (2 * least - both):
                found.append((i, j, float(both / (2 * least - both))))
                end = i + least
                break
    return found


def compare(b: np.ndarray, a: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM, similar: float = SIMILAR) -> list[tuple]:
    """Passages of at least min_words words of b and a (arrays of words) with multiset Jaccard similarity of their tokens
    of at least `similar`: (start b, end b, start a, end a, similarity), found from the longest, then left and right of it.
    A run that isn't similar as a whole is parted at its longest stretch of misses, in b or in a, and its parts are tested;
    one without misses, whose sides differ in how often they hold a token, at its longest common stretch. Where all that
    leaves min_words words of b which are similar to as many of a, these are added."""
    tokens = [textnum.grams(textnum.mix(x.astype(np.int64).view(textnum.U)), np.array([0, len(x)]), gram)[0] for x in (b, a)]
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    tb, ta = ids[: len(tokens[0])], ids[len(tokens[0]) :]
    size = int(ids.max()) + 1 if len(ids) else 0
    least, out, todo = min_words - gram + 1, [], [(0, len(tb), 0, len(ta))]
    needed = _needed(least, similar)

    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        there = np.zeros(size, bool)
        there[y] = True
        return there[x]

    while todo:
        b0, b1, a0, a1 = todo.pop()
        if b1 - b0 < least or a1 - a0 < least:
            continue
        hit = among(tb[b0:b1], ta[a0:a1])
        if hit.sum() < max(1, needed):
            continue
        s, e = _best(hit)
        s, e = s + b0, e + b0
        todo += [(b0, s, a0, a1), (e, b1, a0, a1)]
        if e - s < least:
            continue
        u, v = _best(among(ta[a0:a1], tb[s:e]))
        u, v = u + a0, v + a0
        i, j = _best(among(tb[s:e], ta[u:v])) if v - u >= least else (0, 0)
        if j - i < least:  # that part of a holds too little; the rest of it may hold more
            todo += [(s, e, a0, u), (s, e, v, a1)]
            continue
        todo += [(s, s + i, a0, a1), (s + j, e, a0, a1)]
        s, e = s + i, s + j
        sim, f, w = _jaccard(tb[s:e], ta[u:v], size), e, v
        if sim < similar and e - s != v - u:  # one side repeats itself more often: as much of it as the other holds
            n = min(e - s, v - u)
            f, w = s + n, u + n
            sim = _jaccard(tb[s:f], ta[u:w], size)
        if sim >= similar:
            out.append((s, f + gram - 1, u, w + gram - 1, float(sim)))
            todo.append((f, e, a0, a1))
            continue
        g0, g1 = _gap(~among(tb[s:e], ta[u:v]))
        h0, h1 = _gap(~among(ta[u:v], tb[s:e]))
        if g1 - g0 >= max(1, h1 - h0):
            todo += [(s, s + g0, a0, a1), (s + g1, e, a0, a1)]
        elif h1 > h0:
            todo += [(s, e, a0, u + h0), (s, e, u + h1, a1)]
        else:
            i, j, n = _common(tb[s:e], ta[u:v])
            if n >= least:
                out.append((s + i, s + i + n + gram - 1, u + j, u + j + n + gram - 1, 1.0))
            else:
                i, n = (e - s) // 2, 0
            todo += [(s, s + i, a0, a1), (s + i + n, e, a0, a1)]
    for s, u, sim in _left(tb, ta, [(s, e - gram + 1) for s, e, *_ in out], least, needed, similar):
        out.append((s, s + min_words, u, u + min_words, sim))
    return list(dict.fromkeys(out))


def _verify(min_words: int, gram: int, similar: float):
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("other_doc_id", pa.int64()), ("other_start_word", pa.int32()), ("other_end_word", pa.int32()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, sb, a, sa = (batch.column(i).to_pylist() for i in range(4))
            flat, off = [], []
            for i in (4, 5):
                c = batch.column(i)
                off.append(c.offsets.to_numpy())
                flat.append(c.values.to_numpy())
            out, needed = [], _needed(min_words - gram + 1, similar)
            ends, at, many = off[0] + off[1], 0, [np.zeros(0)]
            while at < batch.num_rows:  # so many pairs that their words are AT_ONCE, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
                many.append(_overlaps(flat, [o[at : to + 1] for o in off], gram))
                at = to
            many = np.concatenate(many)
            for i in np.flatnonzero(many >= needed).tolist():
                x, y = (flat[j][off[j][i] : off[j][i + 1]] for j in (0, 1))
                out += [(b[i], sb[i] + s, sb[i] + e, a[i], sa[i] + u, sa[i] + v, sim) for s, e, u, v, sim in compare(x, y, min_words, gram, similar)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, schema.types)], schema=schema)
            textnum.give_back()

    return run


def _words(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, s, words): the words s to e of the documents of spans (doc, s, e)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    docs = util.among(docs, spans.select("doc"), "doc")
    regions = spans.select("doc", F.array(F.struct("s", "e")).alias("regions"))
    words = docs.join(regions, "doc").select("doc", "text", "regions").mapInArrow(_cut, "doc long, region int, words array<int>")
    return util.materialize(words.select("doc", F.col("region").alias("s"), F.size("words").alias("n"), "words"), "words")


def _checked(words: DataFrame, pairs: DataFrame, min_words: int, gram: int, similar: float) -> DataFrame:
    """The accepted passages of pairs (b, a) of documents."""
    side = lambda k: words.select(F.col("doc").alias(k), F.col("s").alias("s" + k), F.col("words").alias("w" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("b", "sb", "a", "sa", "wb", "wa")
    return both.mapInArrow(_verify(min_words, gram, similar), "doc_id long, start_word int, end_word int, other_doc_id long, other_start_word int, other_end_word int, similarity double")


SIDE_B, SIDE_A = ("doc_id", "start_word", "end_word"), ("other_doc_id", "other_start_word", "other_end_word")


def _classes(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches, passages): what passages that overlap cover of a document, (doc, s, e, class), and the passages with their
    class: the smallest document, and the first word there, of all stretches that passages connect."""
    named = lambda side: passages.select(*[F.col(c).alias(k) for c, k in zip(side, ("doc", "s", "e"))])
    by_doc = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    sides = named(SIDE_B).unionByName(named(SIDE_A)).distinct().withColumn("first", F.when(F.coalesce(F.col("s") >= reach, F.lit(True)), F.col("s")))
    sides = sides.withColumn("first", F.max("first").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = sides.groupBy("doc", "first").agg(F.max("e").alias("e")).withColumn("id", F.monotonically_increasing_id())
    merged = util.materialize(merged, "stretches")
    held = sides.join(merged.drop("e"), ["doc", "first"]).select("doc", "s", "e", "id")
    of = lambda side, k: held.select(*[F.col(c).alias(n) for c, n in zip(("doc", "s", "e", "id"), (*side, k))])
    tied = util.materialize(passages.join(of(SIDE_B, "a"), [*SIDE_B]).join(of(SIDE_A, "b"), [*SIDE_A]), "passages")
    group = util.components(tied.select("a", "b"))
    grouped = merged.join(group, "id")
    name = grouped.groupBy("group").agg(F.min(F.struct("doc", "first")).alias("name"))
    grouped = util.materialize(grouped.join(name, "group"), "stretches")
    labels = grouped.select(F.col("id").alias("a"), F.col("name.doc").alias("class_doc_id"), F.col("name.first").alias("class_start_word"))
    stretches = grouped.select("doc", F.col("first").alias("s"), "e", F.col("group").alias("class"))
    return stretches, tied.join(labels, "a").select(*SIDE_B, *SIDE_A, "similarity", "class_doc_id", "class_start_word")


def _seen(held: DataFrame, words: DataFrame, stretches: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(key, doc, class, inside) of the elements kept: the least class of which each window with the element overlaps a passage,
    null if there is none; and whether one stretch holds all their tokens that other documents hold."""
    of = stretches.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e", "class"))).alias("of"))
    ends = words.groupBy("doc").agg(F.max(F.col("s") + F.col("n")).alias("ends"))
    near = held.select("key", "doc", *shared_tokens.COLUMNS).join(ends.join(of, "doc", "left"), "doc")
    near = near.withColumn("high", F.greatest(F.lit(0), F.least("high", F.col("ends") - min_words))).withColumn("low", F.least("low", "high"))
    near = near.select("key", "doc", *shared_tokens.COLUMNS, F.expr(f"filter(of, x -> x.s < high + {min_words} and x.e > low)").alias("of"))
    met = f"size(of) > 0 and of[0].s < low + {min_words} and element_at(of, -1).e > high and forall(sequence(1, size(of)), i -> i = size(of) or of[i].s - of[i - 1].e < {min_words})"
    one = f"array_min(filter(array_distinct(transform(of, x -> x.class)), c -> exists(array(filter(of, x -> x.class = c)), of -> {met})))"
    inside = F.expr(f"coalesce(exists(of, x -> x.s <= start and end + {gram - 1} <= x.e), false)")
    return near.select("key", "doc", F.expr(one).alias("class"), inside.alias("inside"))


def _apart(seen: DataFrame) -> DataFrame:
    """Pairs (b, a) of documents that keep an element, but not both in windows that overlap passages of one class; and, for each
    element, of those documents but its first whose passages don't hold its windows' tokens, each with the first of these."""
    by = Window.partitionBy("key")
    own = seen.withColumns({"low": F.min("class").over(by), "high": F.max("class").over(by), "none": F.max(F.col("class").isNull()).over(by), "head": F.min("doc").over(by)})
    own = own.withColumn("first", F.min(F.when(F.expr("not inside and doc <> head"), F.col("doc"))).over(by))
    own = own.withColumns({"apart": F.expr("none or low < high"), "second": F.expr("not inside and doc <> head and first < doc")}).where("apart or second")
    own = util.materialize(own.select("key", "doc", "class", "apart", F.expr("if(second, first, null)").alias("first")), "tokens")
    b, a = (own.where("apart").select("key", F.col("doc").alias(k), F.col("class").alias("class_" + k)).distinct() for k in "ba")
    every = b.join(a, "key").where("a < b and not coalesce(class_a = class_b, false)").select("b", "a")
    return every.unionByName(own.where("first is not null").select(F.col("doc").alias("b"), F.col("first").alias("a"))).distinct()


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hashes: int = HASHES, enough: int = ENOUGH, similar: float = SIMILAR) -> DataFrame:
    """One row for each passage of doc_id that (nearly) repeats one of other_doc_id, an earlier document: word ranges of both
    (ends excluded; words as in textnum), the multiset Jaccard similarity of their tokens, and the class of passages that both
    are in. hashes and enough are those of min-hash candidates; no result depends on them."""
    if not 1 <= hashes <= 16 or not gram <= min_words:
        raise ValueError("1 to 16 hash functions, and passages of at least one token")
    width = min_words - gram + 1
    of_key = Window.partitionBy("key")
    held = shared_tokens.find(documents, width, gram, max(1, _needed(width, similar)))
    held = held.withColumns({"a": F.min("doc").over(of_key), "z": F.max("doc").over(of_key)}).where("a < z").drop("z")
    held = util.materialize(held, "tokens")
    spans = held.groupBy("doc").agg(F.min("low").alias("s"), (F.max("high") + min_words).alias("e"))
    words = _words(documents, util.materialize(spans, "spans"))
    star = util.materialize(held.where("a < doc").select(F.col("doc").alias("b"), "a").distinct(), "pairs")
    passages = util.materialize(_checked(words, star, min_words, gram, similar).distinct(), "passages")
    stretches, out = _classes(passages)
    apart = util.materialize(_apart(_seen(held, words, stretches, min_words, gram)).join(star, ["b", "a"], "left_anti"), "pairs")
    util.release(held)
    if not apart.isEmpty():
        more = util.materialize(_checked(words, apart, min_words, gram, similar).distinct(), "passages")
        if not more.isEmpty():
            out = _classes(passages.unionByName(more))[1]
    util.release(words)
    return out
