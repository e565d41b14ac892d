"""Titles, markup and words, as column expressions."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as titles know it: Unicode's, and the four ASCII separators.
BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def normalize_title(c: Column) -> Column:
    """Underscores are spaces; outer blanks go; the first character is a capital, in full case mapping."""
    t = strip(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


@F.pandas_udf(T.StringType())
def _entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """All character references, once. Texts with none but the five of XML stay in the JVM."""
    plain = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    other = F.regexp_like(c, F.lit(r"&(?!(?:lt|gt|quot|amp|#39);)"))
    slow = _entities(F.when(other, c))
    return F.when(other, slow).otherwise(plain)


@lru_cache(1)
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """One-to-one folds as two strings, then those that grow: Latin letters without their marks."""
    special = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ĸ": "q", "ŋ": "n", "Ŋ": "N"}
    one, to, more = "", "", []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        flat = special.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if flat == c or not flat.isascii() or not flat:
            continue
        if len(flat) == 1:
            one, to = one + c, to + flat
        else:
            more.append((c, flat))
    return one, to, more


def fold(c: Column) -> Column:
    """ASCII letters for accented Latin ones; anything else as it is."""
    one, to, more = _folds()
    c = F.translate(c, one, to)
    for a, b in more:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tokens(c: Column) -> Column:
    """Words: runs of letters and numbers, lower case, folded."""
    cut = F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.transform(cut, fold)


def raw_token(c: Column) -> Column:
    """The whole value as one term; outer blanks count."""
    return fold(F.lower(c))


def token_key(c: Column) -> Column:
    return F.array_join(tokens(c), "\u0001")


def fuzzy_budget(c: Column) -> Column:
    """Typos allowed in a word: none up to 3 characters, one up to 7, else two."""
    n = F.char_length(c)
    return F.when(n <= 3, 0).when(n <= 7, 1).otherwise(2)


def osa(a: str, b: str, most: int) -> bool:
    """Whether the optimal string alignment distance is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


@F.pandas_udf(T.BooleanType())
def _within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y, int(m)) for x, y, m in zip(a, b, most)])


def similar(term: Column, word: Column) -> Column:
    """Within the word's budget of typos, a swap of neighbours counting as one. The edit distance, at most twice as large,
    lets few pairs through to the exact test."""
    near = F.levenshtein(term, word, 4)
    may = (near >= 0) & (near <= 2 * fuzzy_budget(word)) & (fuzzy_budget(word) > 0)
    return may & F.coalesce(_within(F.when(may, term), F.when(may, word), fuzzy_budget(word)), F.lit(False))
