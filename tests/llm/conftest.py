import re

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ["doc", "sig", "bands", "band", "a", "b", "h", "at", "before", "after", "score", "key", "tokens", "budget", "source_", "words", "lines", "body", "id", "group", "similarity", "u", "v", "m", "__gone", "__of", "__most", "__score", "toxic", "ids", "failed", "keep", "position", "file", "region", "limit", "threshold"]

PROSE = "the north road runs past old mills and quiet farms where people still grow rye barley hops flax and sell them on market days in town".split()


def prose(seed: int, n: int) -> str:
    """n words without much repetition, the same for a seed."""
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(PROSE[(x >> 8) % len(PROSE)] + (chr(97 + (x >> 16) % 26) if x >> 20 & 1 else ""))
    return " ".join(out)


def plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-zß-῿₀-⿿぀-\U0010ffff]+", text.lower())


@pytest.fixture
def odd(spark):
    """Rows with nulls in every column, empty and long texts, repeats, and columns with clashing names."""
    rows = [
        (1, prose(1, 200), "en", "s", 10), (2, prose(1, 200), "en", "s", 10), (3, "", "en", "s", 0), (4, None, "en", "s", None), (None, "text without an id", "en", "s", 18),
        (5, " \n\t ", None, None, None), (6, prose(6, 300_000), "en", "t", 1), (7, "one", None, "t", 3), (7, "one", None, "t", 3), (None, None, None, None, None), (8, "é" * 50_000, "fr", "", 1), (9, "!!! ... ???", "en", "s", 11),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHING])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
