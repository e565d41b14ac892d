import re

from arcweave.llm import quality
from tests.conftest import SMALL


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x09-\x0d ]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x09-\x0d ]", x)]
    return {
        "n_chars": len(t), "n_words": len(words), "word_chars": sum(map(len, words)), "letters": sum(c.isalpha() for c in t), "capitals": sum(c.isupper() for c in t), "digits": sum(c in "0123456789" for c in t),
        "symbols": sum(c in "#$%&*|<>~^{}\\" for c in t), "shouts": t.count("!!"), "repeats": sum(a == b for a, b in zip(words, words[1:])), "stop_words": len(set(words) & set(quality.STOP)), "n_lines": len(lines), "distinct_lines": len(set(lines)),
    }


def bits(m):
    conditions = {name: c.replace("AND", "and").replace("= 0", "== 0").replace("> ==", ">=") for name, c in quality.RULES}
    return sum(1 << i for i, (name, _) in enumerate(quality.RULES) if eval(conditions[name], {}, m))


def test_ledger_is_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text")):
        texts = [(r.doc_id, brute(r.text)) for r in df.collect()]
        want = sorted([(d is None, d or 0, bits(m), tuple(m.values())) for d, m in texts])
        got = sorted([(r.doc_id is None, r.doc_id or 0, r.failed, tuple(r[k] for k in quality.MEASURES)) for r in quality.ledger(df).collect()])
        assert got == want


def test_odd_rows_and_clashing_names(odd, none):
    got = quality.decide(quality.store(odd))
    assert got.columns == ["doc_id", "keep", "passes", "failed", *quality.MEASURES] and got.count() == odd.count()
    empty = got.where("doc_id = 3").first()
    assert empty["failed"] == quality.mask("empty", "few_words") and not empty["keep"]
    assert quality.decide(quality.ledger(none)).count() == 0 and quality.ablate(quality.ledger(none)).count() == 0


def test_policies_and_ablation(spark):
    entries = quality.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))
    failed = [(r.failed, r.n_words) for r in entries.select("failed", "n_words").collect()]
    for r in quality.ablate(entries).collect():
        m, bit = quality.POLICIES[r.policy], quality.mask(r.rule)
        only = [w for f, w in failed if f & m == bit]
        assert (r.documents, r.failing, r.only) == (len(failed), sum(f & bit > 0 for f, _ in failed), len(only))
        assert r.kept_without == sum(f & m & ~bit == 0 for f, _ in failed) and r.words_regained == sum(only)


def test_a_stored_ledger_serves_every_policy(spark, tmp_path):
    """Policies and ablations read the stored bits, no text."""
    entries = quality.store(spark.read.parquet(f"{SMALL}/documents.parquet"), str(tmp_path / "ledger"))
    assert "text" not in entries._jdf.queryExecution().toString() and str(tmp_path) in entries.inputFiles()[0]
    assert quality.decide(entries).count() == entries.count() and quality.ablate(entries).count() == sum(bin(m).count("1") for m in quality.POLICIES.values())
