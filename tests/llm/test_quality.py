import re
from collections import Counter

from pyspark.sql import functions as F

from shoplake.llm.quality import RULES, STOP_WORDS, Rule, judge
from tests.llm.common import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_counts_match_brute_force(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark).withColumn("words", F.lit(1)).withColumn("kept", F.lit("x"))):
        local = docs.select("doc_id", "text").toPandas()
        got = judge(docs).toPandas()
        assert len(got) == len(local)
        key = lambda r: (-1 if r[0] != r[0] or r[0] is None else r[0], *r[1:])
        want = sorted(key((d, *brute(t))) for d, t in zip(local["doc_id"], local["text"]))
        have = sorted(key(tuple(r)) for r in got[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False))
        assert have == want
        assert not (got["kept"] & got["base_failed"]).any()
    assert judge(empty(spark)).count() == 0


STOP = set(STOP_WORDS)


def brute_failed(text):
    """The threshold table, rule by rule in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, dup_lines, hit, _ = brute(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    per = max(1, n)
    value = {
        "n_words": n, "repeat_word_ratio": hit / per, "mean_word_chars": chars / per, "symbol_ratio": symbols / per, "exclamation_ratio": text.count("!") / per, "stop_word_ratio": sum(w.lower() in STOP for w in words) / per,
        "dup_line_ratio": dup_lines / max(1, len(lines)), "ended_line_ratio": sum(bool(re.search(r"[.!?:;][\"')]*[\x09-\x0D\x20]*$", x)) for x in lines) / max(1, len(lines)),
    }
    return [r.name for r in RULES if n >= r.least_words and ((r.low is not None and value[r.metric] < r.low) or (r.high is not None and value[r.metric] > r.high))]


def test_kept_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["word! " * 60, "a#b " * 30, "x" * 500 + " the" * 12, "\n".join(["same line here now."] * 9), "one two three four five six seven eight nine ten the of and\n" * 1, "no stop at all " * 1 + "zzz " * 60, "Fin.\")\t\n" + "la le les " * 70]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r.doc_id: (list(r.failed_rules), r.kept) for r in judge(docs).collect()}
    want = {r.doc_id: (f := brute_failed(r.text), not f and not brute(r.text)[-1]) for r in docs.collect()}
    assert got == want and len({x for f, _ in want.values() for x in f}) >= 6


def test_verdict_follows_labels(spark):
    d = "/root/testdata/sf0.01"
    got = judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.99


def test_no_user_functions_and_the_table_is_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    strict = judge(docs, (*RULES, Rule("all", "n_words", None, -1)))
    assert strict.filter("kept").count() == 0
