"""Schemas of the tables that stages exchange; readers fail on anything else instead of guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

U32 = 1 << 32

PAGES = "title string, is_redirect boolean, redirect_target string"
LINKS = "source string, target string"
NODES = "id bigint, title string"
EDGES = "src bigint, dst bigint"
ALIASES = "alias string, id bigint"
ENRICHED = "id bigint, title string, pagerank double, partition bigint, x double, y double, radius double"
SEARCH_DOC = "id bigint, t string, x double, y double, r double, cl bigint, imp double, a array<string>"
HIT = "id bigint, t string, x double, y double, r double, cl bigint"
TILE = "z int, x int, y int, tile_id bigint, data binary"


def require(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl; an error names what is missing or of another type."""
    want = T._parse_datatype_string(ddl)
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}, not {f.dataType.simpleString()}" for f in want.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df.select(*want.names)
