"""Quality rules: a table of thresholds compiled into Spark projections, with no user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en et la le les par pas pour qui que sur un une "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich und von zu "
    "al con del el es lo los las no para por se su una y"
).split()

SPACE = "[\\x09-\\x0D\\x20]"


class Rule(NamedTuple):
    """A document with at least ``least_words`` words fails where ``metric`` is outside [low, high]."""

    name: str
    metric: str
    low: float | None
    high: float | None
    least_words: int = 0


#: The threshold table.
RULES = (
    Rule("too_few_words", "n_words", 10, None),
    Rule("repeated_words", "repeat_word_ratio", None, 0.20),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("exclamations", "exclamation_ratio", None, 0.30),
    Rule("stop_words", "stop_word_ratio", 0.02, None, 50),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("line_ends", "ended_line_ratio", 0.10, None, 200),
)
#: The rules that make up base_failed.
BASE = ("too_few_words", "repeated_words")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, which a lambda that names a plain column expression would not do."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(windows: Column, span: int) -> Column:
    """Words covered by windows whose hash occurs twice or more; the sort is only reached by texts that have such."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(span), F.coalesce(F.get(p, j + 1) - x, F.lit(span)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(pairs, twice), covered)).otherwise(F.lit(0).cast("long"))


def metrics(docs: DataFrame, span: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with counts and ratios, all from built-in functions.

    A word is hashed once and a window by the hashes of its words. Windows are
    compared within one text, so a wrong count needs a collision of 64-bit hashes
    in that text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # One-element explodes fix a value as a column: filters that callers add are not pushed below them, which would copy whole expressions.
    split = docs.select("doc_id", *carry, text.alias("text"), F.explode(F.array(F.array_remove(F.split(text, SPACE + "+"), ""))).alias("words"))
    split = split.select("*", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes"))
    words, text, hashes = F.col("words"), F.col("text"), F.col("hashes")
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(span)])
    windows = F.when(F.size(words) >= span, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - span, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))
    parts = split.select(
        "doc_id", *carry, F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclamations"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x09-\\x0D\\x20]")).alias("lines"), F.explode(F.array(windows)).alias("windows"),
    )
    lines, n = F.col("lines"), F.greatest("n_words", F.lit(1))
    counted = parts.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.size(F.filter(lines, lambda x: x.rlike("[.!?:;][\"')]*[\\x09-\\x0D\\x20]*$"))).cast("long").alias("n_ended_lines"),
        F.explode(F.array(_repeated(F.col("windows"), span))).alias("n_repeat_words"),
    )
    return counted.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / n, "exclamation_ratio": F.col("n_exclamations") / n, "stop_word_ratio": F.col("n_stop_words") / n,
            "repeat_word_ratio": F.col("n_repeat_words") / n, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "ended_line_ratio": F.col("n_ended_lines") / F.greatest("n_lines", F.lit(1)),
        }
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The table as one expression: an array of the names of failed rules."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < F.lit(r.low))
        if r.high is not None:
            bad = bad | (F.col(r.metric) > F.lit(r.high))
        tests.append(F.when(bad & (F.col("n_words") >= r.least_words), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` and ``kept`` for every row of ``docs`` (doc_id, text).

    Null and word-less texts count as empty: no words, so they fail the first
    rule; very long texts are read whole. ``carry`` names columns to keep beside
    the counts. Repeated rows are judged one by one, extra columns are ignored,
    an empty table gives no rows. Whole numbers decide base_failed, so no rounding.
    """
    out = metrics(docs, carry=carry).withColumn("failed_rules", compile_rules(rules))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("failed_rules") == 0))


def good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are kept, with all their columns, whatever their names; null and empty texts go, repeated rows stay or go together."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("whole_row"))
    return judge(whole, rules, carry=("whole_row",)).filter("kept").select("whole_row.*")
