"""Secrets in texts: an Aho-Corasick automaton over the keywords of all rules reads each whole text once; only near its
hits a rule's regular expression is tried, anchored where the keyword stands; what matches must pass the rule's check.
What vouches for a finding is its evidence: `checksum`, the CRC32 in base 62 that GitHub and npm tokens carry; `structure`,
the decodable header of a JWT, the Base32 account of an AWS key id or the Base64 lines of a private key; or `variety`,
where a format carries neither: enough different characters, more of them where the value isn't quoted.

Secrets may be of any length, and the time is linear in the text: no two hits read the same run of characters for the same
rule (see Rule.before), and a private key ends at the first dashes after its head.

Defined results. Null and empty texts have no findings and stay as they are; very long texts are read whole, in one task,
with some 4 bytes of memory a byte; a null doc_id stays null; repeated rows repeat their findings. Of findings that
overlap, the one that begins first stays, then the longest, then the first rule by name. Positions are characters, ends
excluded. redact() keeps every row and column, whatever the columns' names; it replaces each finding by [SECRET:rule] and
counts n_chars, if there is such a column, anew in the changed rows. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm import textnum, util

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.encode()


def _crc(m: re.Match) -> int:
    body = m[0].rpartition(b"_")[2]
    return m.end() * (crc_base62(body[:-6]) == body[-6:])


def _jwt(m: re.Match) -> int:
    try:
        parts = [base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4)) for x in m[0].split(b".")[:2]]
        return m.end() * ("alg" in json.loads(parts[0]) and isinstance(json.loads(parts[1]), dict))
    except (ValueError, TypeError, RecursionError):
        return 0


def _aws(m: re.Match) -> int:
    """The 40 bits after the prefix hold the account, of 12 digits at most."""
    return m.end() * ((int.from_bytes(base64.b32decode(m[0][4:]), "big") >> 39) & ((1 << 40) - 1) < 10**12)


def _pem(m: re.Match) -> int:
    """From the head to the next dashes, which must be those of its end; between them header lines, if any, and Base64."""
    raw = m.string
    stop = raw.find(b"-----", m.end())
    tail = b"-----END " + m[1] + b"PRIVATE KEY-----"
    if stop < 0 or not raw.startswith(tail, stop):
        return 0
    lines = [x for x in raw[m.end() : stop].split(b"\n") if b": " not in x]
    try:
        return (stop + len(tail)) * (len(base64.b64decode(b"".join(b"".join(lines).split()), validate=True)) >= 16)
    except ValueError:
        return 0


def _mixed(s: bytes, different: int, digits: int) -> bool:
    return len(set(s)) >= different and sum(48 <= c <= 57 for c in s) >= digits and any(c > 64 for c in s)


def _varied(m: re.Match) -> int:
    """Digits and letters, and at least 8 different characters in the secret part."""
    return m.end() * _mixed(m[m.lastindex or 0], 8, 1)


def _bare(m: re.Match) -> int:
    """A value without quotes: 12 different characters, 2 digits, small and capital letters or hexadecimal digits alone."""
    s = m[1]
    cased = s.lower() != s and s.upper() != s
    return m.end() * (_mixed(s, 12, 2) and (cased or not s.strip(b"0123456789abcdef")))


class Rule(NamedTuple):
    """check gives the end of what matched, or 0. No match may begin after a character of the class before: a run is then
    tried from its start alone."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[re.Match], int]
    evidence: str
    before: str = ""


_END = r"(?![A-Za-z0-9_])"
_NAMES = ("token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key", "private_key")
_NAME = r"""(?i:token|secret|passw(?:or)?d|(?:api[_-]?|access_|private_)key)"""
_ALNUM = "[A-Za-z0-9]"
RULES = [
    Rule("assigned_secret", _NAMES, _NAME + r"""["']?[ \t]{0,4}(?:=|:|=>|:=)[ \t]{0,4}(["'])([A-Za-z0-9+/_=.\-]{16,})\1""", _varied, "variety"),
    Rule("assigned_value", _NAMES, _NAME + r"""[ \t]{0,4}[:=][ \t]{0,4}([A-Za-z0-9+/_.\-]{20,}={0,2})(?![^\s;,])""", _bare, "variety"),
    Rule("aws_key_id", ("akia", "asia"), r"(?:AKIA|ASIA)[A-Z2-7]{16}" + _END, _aws, "structure", _ALNUM),
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}" + _END, _crc, "checksum", _ALNUM),
    Rule("gitlab_token", ("glpat-",), r"glpat-([A-Za-z0-9_\-]{20})" + _END, _varied, "variety"),
    Rule("google_key", ("aiza",), r"AIza([A-Za-z0-9_\-]{35})" + _END, _varied, "variety"),
    Rule("jwt", ("eyj",), r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", _jwt, "structure", r"[A-Za-z0-9_.\-]"),
    Rule("npm_token", ("npm_",), r"npm_[A-Za-z0-9]{36}" + _END, _crc, "checksum", _ALNUM),
    Rule("private_key", ("-----begin",), r"-----BEGIN ((?:[A-Z0-9]{1,32} ){0,3})PRIVATE KEY-----", _pem, "structure"),
    Rule("slack_token", ("xox",), r"xox[abeprs]-([A-Za-z0-9\-]{20,})", _varied, "variety", r"[A-Za-z0-9\-]"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), r"[sr]k_live_([A-Za-z0-9]{20,})" + _END, _varied, "variety", _ALNUM),
]


@lru_cache(1)
def _machine():
    import ahocorasick

    out = ahocorasick.Automaton()
    by_word: dict[str, list] = {}
    for rule in RULES:
        for k in rule.keywords:
            by_word.setdefault(k, []).append((len(k), rule, re.compile(rule.pattern.encode()), re.compile(rule.before.encode()) if rule.before else None))
    for k, v in by_word.items():
        out.add_word(k, v)
    out.make_automaton()
    return out


def scan(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, rule, evidence, fingerprint) of each finding, by position."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    for last, rules in _machine().iter(raw.lower().decode("latin-1")):
        for n, rule, pattern, before in rules:
            start = last - n + 1
            if before and start and before.match(raw, start - 1):
                continue
            if (m := pattern.match(raw, start)) and (end := rule.check(m)):
                found.append((start, end, rule))
    out, done, at, chars = [], 0, 0, 0
    for a, b, rule in sorted(set(found), key=lambda f: (f[0], -f[1], f[2].name)):
        if a < done:
            continue
        chars += len(raw[at:a].decode("utf-8", "surrogatepass"))
        at = done = b
        n = len(raw[a:b].decode("utf-8", "surrogatepass"))
        out.append((chars, chars + n, rule.name, rule.evidence, hashlib.sha256(raw[a:b]).hexdigest()[:16]))
        chars += n
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("checksum", pa.bool_()), ("evidence", pa.string()), ("fingerprint", pa.string())])
    for batch in batches:
        for part in textnum.pieces(batch, "text"):
            rows = [(d, rule, a, b, proof == "checksum", proof, mark) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for a, b, rule, proof, mark in scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types)], schema=schema)


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, rule, start_char, end_char, checksum, evidence, fingerprint), one row for each secret; never the secret itself."""
    docs = util.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_find, "doc_id long, rule string, start_char long, end_char long, checksum boolean, evidence string, fingerprint string")


def _redacted(text: str) -> str:
    out, at = [], 0
    for a, b, rule, _, _ in scan(text):
        out += [text[at:a], f"[SECRET:{rule}]"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(documents: DataFrame) -> DataFrame:
    """documents with every secret replaced; same rows, same columns."""
    text, count = documents.columns.index("text"), documents.columns.index("n_chars") if "n_chars" in documents.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.pieces(batch, "text"):
                old, cols = part.column(text).to_pylist(), list(part.columns)
                new = [_redacted(t) if t else t for t in old]
                if new != old:
                    cols[text] = pa.array(new, cols[text].type)
                    if count >= 0:
                        cols[count] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, cols[count].to_pylist())], cols[count].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return util.small_batches(documents).mapInArrow(run, documents.schema)
