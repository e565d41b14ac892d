"""A ledger of quality rules.

Every rule is evaluated once for each document: the ledger, which store() writes, keeps the counts that it measures and one
bit for each rule that fails. A policy is a version and the mask of the rules that it applies; deciding, comparing policies
and ablating rules are then bitwise operations on the stored ledger and read no text again. All measurements are whole numbers and all rules
compare products of them, so results don't depend on rounding.

Words are runs of characters other than white space (U+0009 to U+000D and U+0020); lines are cut at U+000A and those
without a word don't count.

Defined results. A null text counts as empty; an empty one has 0 for every measurement, fails the rule `empty` and no
other but `few_words`. A very long text is measured whole, in one task. Rules have no order, so there are no ties. A null doc_id is carried along; repeated rows repeat. Other columns are not read, so their names
can't clash. An empty table gives an empty ledger and an empty ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm import util

STOP = "the and of to in is it that with for on as are der die und das von mit ist zu ein den de la que el en los del las por para le les et des un une dans est pour sur".split()
SYMBOLS = r"[#$%&*|<>~^{}\x5c]"
SPACE = r"[\x09-\x0D ]"

#: Measurements as SQL that Spark and DuckDB share, but for the three functions of _dialect.
MEASURES = {
    "n_chars": "length(body)",
    "n_words": "LEN(words)",
    "word_chars": f"COUNT(body, '[^\\x09-\\x0D ]')",
    "letters": r"COUNT(body, '\p{L}')",
    "capitals": r"COUNT(body, '\p{Lu}')",
    "digits": "COUNT(body, '[0-9]')",
    "symbols": f"COUNT(body, '{SYMBOLS}')",
    "shouts": "COUNT(body, '!!')",
    "repeats": "REPEATS(words)",
    "stop_words": "STOPS(words)",
    "n_lines": "LEN(lines)",
    "distinct_lines": "DISTINCT(lines)",
}

#: (rule, the condition under which a document fails it); the position is the bit.
RULES = [
    ("empty", "n_words = 0"),
    ("few_words", "n_words < 50"),
    ("many_words", "n_words > 100000"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("few_letters", "10 * letters < 6 * word_chars"),
    ("capitals", "10 * capitals > 4 * letters"),
    ("digits", "10 * digits > 3 * word_chars"),
    ("symbols", "10 * symbols > 2 * n_words"),
    ("shouts", "10 * shouts > 2 * n_words"),
    ("repeated_words", "10 * repeats > 2 * n_words"),
    ("no_stop_words", "n_words >= 50 AND stop_words = 0"),
    ("repeated_lines", "n_lines >= 4 AND 10 * (n_lines - distinct_lines) > 5 * n_lines"),
]


def mask(*rules: str) -> int:
    names = [r for r, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


#: Version 1 wants long documents, as for pretraining on web pages; version 2, the current one, keeps clean short ones.
POLICIES = {
    1: mask(*(r for r, _ in RULES)),
    2: mask(*(r for r, _ in RULES if r != "few_words")),
}
CURRENT = 2


def _spark(measure: str) -> str:
    stop = "array(" + ", ".join(f"'{w}'" for w in STOP) + ")"
    if measure.startswith("COUNT("):
        pattern = measure[measure.index("'") :]
        return f"regexp_count(body, r{pattern}"
    return {
        "LEN(words)": "size(words)",
        "LEN(lines)": "size(lines)",
        "DISTINCT(lines)": "size(array_distinct(lines))",
        "REPEATS(words)": "size(filter(zip_with(words, slice(words, 2, size(words)), (a, b) -> a = b), x -> x))",
        "STOPS(words)": f"size(array_intersect({stop}, words))",
    }.get(measure, measure)


def ledger(documents: DataFrame) -> DataFrame:
    """(doc_id, failed, the measurements): failed has a bit for each rule that the document fails."""
    doc = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    doc = doc.select("doc_id", "body", F.expr(rf"filter(split(body, r'{SPACE}+'), x -> x <> '')").alias("words"), F.expr(rf"filter(split(body, r'\n'), x -> rlike(x, r'[^\x09-\x0D ]'))").alias("lines"))
    doc = doc.select("doc_id", *[F.expr(_spark(m)).cast("long").alias(k) for k, m in MEASURES.items()])
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
    return doc.select("doc_id", F.expr(f"CAST({bits} AS BIGINT)").alias("failed"), *MEASURES)


def passes(version: int = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def store(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger of documents, written once (to the shared folder if no path is given) and read back."""
    if path is None:
        return util.materialize(ledger(documents), "ledger")
    ledger(documents).write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path)


def decide(entries: DataFrame) -> DataFrame:
    """A ledger's entries with keep (of the current policy) and passes (the versions that the document passes)."""
    versions = F.array_compact(F.array(*[F.when(passes(v), F.lit(v)) for v in sorted(POLICIES)]))
    return entries.select("doc_id", passes().alias("keep"), F.array_join(versions.cast("array<string>"), ",").alias("passes"), "failed", *MEASURES)


def ablate(entries: DataFrame) -> DataFrame:
    """(policy, rule, documents, failing, only, kept_without, words_regained): for each rule of each policy the documents
    that fail it, those that fail nothing else, and what leaving it out would keep and regain. One aggregation of the
    ledger by its bits; the rest reads those few rows."""
    known = entries.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    rules = [(v, r, 1 << i, m) for v, m in sorted(POLICIES.items()) for i, (r, _) in enumerate(RULES) if m >> i & 1]
    table = entries.sparkSession.createDataFrame(rules, "policy int, rule string, bit long, mask long")
    hit, rest = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return known.crossJoin(F.broadcast(table)).groupBy("policy", "rule", "bit").agg(
        F.sum("n").cast("long").alias("documents"), count(hit).alias("failing"), count(rest == F.col("bit")).alias("only"),
        (count(rest == 0) + count(rest == F.col("bit"))).alias("kept_without"), F.coalesce(F.sum(F.when(rest == F.col("bit"), F.col("w"))), F.lit(0)).cast("long").alias("words_regained"),
    ).drop("bit")


def _duck(measure: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
    if measure.startswith("COUNT("):
        pattern = measure[measure.index("'") :]
        return f"len(regexp_extract_all(body, {pattern})"
    return {
        "LEN(words)": "len(words)",
        "LEN(lines)": "len(lines)",
        "DISTINCT(lines)": "len(list_distinct(lines))",
        "REPEATS(words)": "len(list_filter(list_zip(words, words[2:]), lambda x: x[1] = x[2]))",
        "STOPS(words)": f"len(list_intersect({stop}, words))",
    }.get(measure, measure)


def ledger_sql(table: str = "documents") -> str:
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
    measured = ", ".join(f"CAST({_duck(m)} AS BIGINT) AS {k}" for k, m in MEASURES.items())
    return rf"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS body FROM {table}),
parts AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '{SPACE}+'), lambda x: x <> '') AS words,
          list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS lines FROM body),
measured AS (SELECT doc_id, {measured} FROM parts),
ledger AS (SELECT doc_id, CAST({bits} AS BIGINT) AS failed, {", ".join(MEASURES)} FROM measured)
"""


def decide_sql(table: str = "documents") -> str:
    versions = ", ".join(f"CASE WHEN failed & {POLICIES[v]} = 0 THEN '{v}' END" for v in sorted(POLICIES))
    return ledger_sql(table) + f"SELECT doc_id, failed & {POLICIES[CURRENT]} = 0 AS keep, concat_ws(',', {versions}) AS passes, failed, {', '.join(MEASURES)} FROM ledger"


def ablate_sql(table: str = "documents") -> str:
    rules = ", ".join(f"({v}, '{r}', {1 << i}::BIGINT, {m}::BIGINT)" for v, m in sorted(POLICIES.items()) for i, (r, _) in enumerate(RULES) if m >> i & 1)
    return ledger_sql(table) + f"""
SELECT policy::INTEGER AS policy, rule, count(*)::BIGINT AS documents, count(*) FILTER (failed & bit <> 0)::BIGINT AS failing, count(*) FILTER (failed & mask = bit)::BIGINT AS only,
       (count(*) FILTER (failed & mask = 0) + count(*) FILTER (failed & mask = bit))::BIGINT AS kept_without, coalesce(sum(n_words) FILTER (failed & mask = bit), 0)::BIGINT AS words_regained
FROM ledger, (VALUES {rules}) r(policy, rule, bit, mask) GROUP BY policy, rule, bit"""
