import bz2
import html
import re

import pytest
from pyspark.sql import functions as F

from arcweave.functions import text as X
from arcweave.operators import extract
from arcweave.sources import dump
from arcweave.streaming import pages

CASES = [
    ("x_y", "0", "A [[foo]] [[ Bar baz |label]] [[Foo#part]] [[category:Kept]] [[Category:Gone]] [[x y]] [[#here]] [[a{b]]"),
    ("AT&amp;T", "0", "&lt;ref&gt;[[Press]]&lt;/ref&gt; [[Phone]] &lt;ref name=x/&gt; [[Bell]] &amp;eacute; [[&eacute;clair]]"),
    ("Old", "0", "text #redirect [[new_name#x]]"),
    ("Late", "0", "x" * 300 + "#REDIRECT [[Nowhere]] [[Real]]"),
    ("Cut", "0", "[[One]] === Further Reading === [[Two]]"),
    ("Talk", "1", "[[Hidden]]"),
    ("", "0", "[[From nothing]]"),
    ("Nested", "0", "[[File:a.jpg|caption [[Lost]] end]] [[Found]]"),
]


def xml(cases=CASES) -> str:
    return "<mediawiki>" + "".join(f"<page>\n<title>{t}</title><ns>{n}</ns><id>1</id><text bytes=\"1\">{b}</text></page>\n" for t, n, b in cases) + "<page><title>No text</title><ns>0</ns></page></mediawiki>"


def plain(cases=CASES):
    """The same by hand, one page at a time: {title: links or redirect target}."""
    up = lambda t: (lambda s: s[:1].upper() + s[1:])(t.replace("_", " ").strip())
    out = {}
    for t, n, b in cases:
        if n != "0":
            continue
        title, body = up(html.unescape(t)), re.sub(extract.CITATION, "", html.unescape(b), flags=re.S)
        body = re.split(extract.TAIL[:-2], body, flags=re.I)[0]
        if m := re.search(extract.REDIRECT, body[:300], re.I):
            out[title] = up(m[1])
            continue
        raw = [x.strip() for x in re.findall(extract.LINK, body)]
        out[title] = sorted({up(x) for x in raw if x and not x.startswith(extract.FOREIGN)} - {title})
    return out


def test_pages_and_links(spark):
    chunks = spark.createDataFrame([(xml(),)], "xml string")
    done = extract.classify(extract.parse_pages(extract.split_pages(chunks)))
    got = {r.title: r.redirect_target if r.is_redirect else [] for r in done.collect()}
    for r in extract.extract_links(done).groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("t")).collect():
        got[r.source] = sorted(r.t)
    assert got == plain() and got["Nested"] == ["Found"] and got["Old"] == "New name" and "Category:Kept" in got["X y"]


def test_titles_like_python(spark):
    names = ["_a_b_", " nbsp ", "ßharp", "", "  ", "éa", "\x1cx", "ŉ", "9a", "日本"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    want = [(lambda s: s[:1].upper() + s[1:])(n.replace("_", " ").strip()) for n in names]
    assert [r[0] for r in df.select(X.normalize_title(F.col("t"))).collect()] == want
    ents = ["a &amp;amp; b", "&eacute;&#x41;&#66;", "no", "&bogus;", "&lt;&copy"]
    df = spark.createDataFrame([(n,) for n in ents], "t string")
    assert [r[0] for r in df.select(X.decode_entities(F.col("t"))).collect()] == [html.unescape(e) for e in ents]


def test_redirect_chains_and_cycles(spark):
    rows = [(f"r{i}", f"r{i + 1}") for i in range(14)] + [("a", "b"), ("b", "a"), ("self", "self"), ("dead", "nothing")]
    got = {r.alias: r.target for r in extract.resolve_redirects(spark.createDataFrame(rows, "alias string, target string")).collect()}
    moves = dict(rows)

    def chase(x):
        for _ in range(extract.HOPS):
            if moves.get(x) in (None, x):
                break
            x = moves[x]
        return x

    assert got == {k: chase(k) for k in moves}


def test_dump_with_an_index(spark, tmp_path):
    parts = [bz2.compress(xml(CASES[i : i + 3]).encode()) for i in range(0, len(CASES), 3)]
    (tmp_path / "d.xml.bz2").write_bytes(b"".join(parts))
    offsets = [sum(map(len, parts[:i])) for i in range(len(parts))]
    lines = "".join(f"{offsets[i // 3]}:{i}:{t}: with colon\n" for i, (t, *_ ) in enumerate(CASES))
    (tmp_path / "index.txt.bz2").write_bytes(bz2.compress(lines.encode()))
    got = dump.read_dump(spark, str(tmp_path / "d.xml.bz2"), str(tmp_path / "index.txt.bz2"))
    assert {r.title for r in got.collect()} == set(plain())
    again = extract.parse_pages(extract.split_pages(dump.read_pages(spark, str(tmp_path / "d.xml.bz2"))))
    assert {r.title for r in again.collect()} == set(plain())


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, c in enumerate(CASES):
        (folder / f"{i}.xml").write_text(xml([c]))
    q = pages.write_links(pages.read_links(spark, str(folder), files=3), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = {(r.source, r.target) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(s, t) for s, ts in plain().items() if isinstance(ts, list) for t in ts}


@pytest.mark.parametrize(("a", "b", "most", "want"), [("phsycology", "psychology", 2, True), ("abc", "ca", 2, False), ("ab", "ba", 1, True), ("", "ab", 1, False), ("same", "same", 0, True)])
def test_distance(a, b, most, want):
    assert X.osa(a, b, most) is want
