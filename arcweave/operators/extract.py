"""From page records with wiki markup to nodes, edges and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave import storage
from arcweave.functions import text as X

HOPS = 10
HEAD = 300

#: Regular expressions in the dialect that Java shares with others; \x5B and \x5D are the square brackets.
LINK = r"\x5B{2}([^#<>\n\x5D{|}]+)(?:[#|][^\x5D]*)?\x5D{2}"
REDIRECT = r"#redirect\s*\x5B{2}([^#|\x5D]+)"
CITATION = r"<ref(?:[^>]*?/>|[^>]*>.*?</ref>)"
TAIL = r"==\s*(?:bibliography|citations|external links|footnotes|further reading|notes|references|sources|works cited)\s*==.*"
#: Targets of other namespaces, told by how they begin; `#` is a link within the page.
FOREIGN = tuple(f"{w}:" for w in sorted("WP Wikipedia User Talk TimedText Template Special Portal Module MediaWiki Image Help File Draft Category Book".split())) + ("#",)


def split_pages(chunks: DataFrame, xml: str = "xml") -> DataFrame:
    """One row (page) for each page element of each chunk."""
    return chunks.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<page>(.*?)</page>"), F.lit(1))).alias("page"))


def parse_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """(title, body) of articles: namespace 0, with a title and a text; entities decoded, citations and the tail of the
    page from the first reference-like heading on cut off."""
    p = F.col(page)
    whole = r"(?s)<text(?:[^>]*)>(.*?)</text>"
    kept = pages.where((F.regexp_extract(p, r"<ns>([0-9]+)</ns>", 1) == "0") & p.rlike(r"<title>[^<]*</title>") & p.rlike(whole))
    kept = kept.select(X.normalize_title(X.decode_entities(F.regexp_extract(p, r"(?<=<title>)[^<]*(?=</title>)", 0))).alias("title"), X.decode_entities(F.regexp_extract(p, whole, 1)).alias("body"))
    return kept.withColumn("body", F.regexp_replace(F.regexp_replace("body", f"(?s){CITATION}", ""), f"(?siuU){TAIL}", ""))


def classify(parsed: DataFrame) -> DataFrame:
    """parsed with is_redirect and redirect_target; a redirect may stand anywhere in the first characters."""
    head = F.substring("body", 1, HEAD)
    found = head.rlike(f"(?iuU){REDIRECT}")
    target = X.normalize_title(F.regexp_extract(head, f"(?iuU){REDIRECT}", 1))
    return parsed.withColumns({"is_redirect": found, "redirect_target": F.when(found, target)})


def _foreign(t: Column) -> Column:
    out = F.lit(False)
    for p in FOREIGN:
        out = out | t.startswith(p)
    return out


def extract_links(classified: DataFrame) -> DataFrame:
    """(source, target) of the articles' links, each once, without those to the page itself or another namespace."""
    raw = F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), X.strip)
    kept = F.array_distinct(F.transform(F.filter(raw, lambda t: (t != "") & ~_foreign(t)), X.normalize_title))
    return classified.where("not is_redirect").select(F.col("title").alias("source"), F.explode(kept).alias("target")).where("target <> source")


def resolve_redirects(redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """(alias, target) with chains followed for at most `hops` steps; a page that redirects to itself ends its chain. Every
    hop is a join on the short table of redirects; chains that have ended drop out of the later ones."""
    step = redirects.select(F.col("alias").alias("from"), F.col("target").alias("to")).where("from <> to")
    step = step.groupBy("from").agg(F.max("to").alias("to"))
    out = redirects.groupBy("alias").agg(F.max("target").alias("target"))
    for _ in range(hops - 1):
        out = out.join(step, out["target"] == step["from"], "left").select("alias", F.coalesce("to", "target").alias("target"))
    return out


def dense_ids(df: DataFrame, *order: str, name: str = "id", start: int = 0) -> DataFrame:
    """df with the position of each row in that order. Range partitions are sorted by themselves and shifted by the sizes
    of those before, so no task holds all rows; written once, because a second sampling could cut the ranges otherwise."""
    spot = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(spot, 33).cast("int").alias("_part"), spot.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    held = storage.materialize(sorted_, "ordinals")
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + start).alias(name))  # one row a partition


def build_nodes(classified: DataFrame) -> DataFrame:
    """(id, title) of the articles, ids by title from 0."""
    return dense_ids(classified.where("not is_redirect").select("title"), "title").select("id", "title")


def build_edges(links: DataFrame, nodes: DataFrame, redirects: DataFrame) -> DataFrame:
    """(src, dst), each once, redirects followed, without links to nothing and loops."""
    there = links.join(redirects.withColumnsRenamed({"target": "end"}), links["target"] == F.col("alias"), "left").select("source", F.coalesce("end", "target").alias("target"))
    ids = lambda title, to: nodes.select(F.col("title").alias(title), F.col("id").alias(to))
    return there.join(ids("source", "src"), "source").join(ids("target", "dst"), "target").where("src <> dst").select("src", "dst").distinct()


def build_aliases(redirects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(alias, id) of the redirects that end at an article."""
    return redirects.join(nodes.withColumnsRenamed({"title": "target"}), "target").select("alias", "id")
