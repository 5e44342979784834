"""Toxic passages by maximum-scoring segments.

Tokens score their log-odds between toxic and clean labelled rows under Dirichlet
priors: a word's prior is the posterior of its stem (first bytes), a stem's prior
that of the corpus. Words whose log-odds can't be told from nothing are one class
and share the log-odds of the class; both signs count, so clean words end a
passage. A linear-time scan finds all maximal segments of a text; the
extreme-value law of segment scores turns them into significances, which are
summed and calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.llm.sampling import least_hashed
from shoplake.llm.store import written

STEM = 5
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SCORES = "doc_id long, score double, predicted int, n_tokens long, n_passages int, passages array<struct<start:long,length:long,score:double,significance:double>>"
PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("significance", pa.float64())]))


class Model(NamedTuple):
    words: dict[bytes, float]
    stems: dict[bytes, float]
    default: float
    lam: float
    log_k: float
    weights: tuple[float, float]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII marks."""
    return (text or "").lower().encode("utf-8").translate(None, _MARKS).split()


def segments(at: list[int], scores: list[float], default: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text whose tokens ``at`` score ``scores`` and all others ``default`` < 0; linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    total, last = 0.0, 0
    for i, s in zip(at, scores):
        total += default * (i - last)
        last = i + 1
        if s <= 0:
            total += s
            continue
        start, left, right = i, total, total + s
        total = right
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                found.append((start, i + 1, left, right))
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, r - lo) for a, b, lo, r in found]


def scan(text: str | None, words: dict[bytes, float], stems: dict[bytes, float], default: float) -> tuple[int, list[tuple[int, int, float]]]:
    """How many tokens a text has, and its maximal segments. A word that isn't in ``words`` scores as its stem, if that is known."""
    toks = tokens(text)
    at = [i for i, w in enumerate(toks) if w[:STEM] in stems]
    return len(toks), segments(at, [words.get(toks[i], stems[toks[i][:STEM]]) for i in at], default)


def significances(n: int, parts: list[tuple[int, int, float]], lam: float, log_k: float) -> list[float]:
    """How far, in nats, each passage lies beyond the best score expected in n clean tokens; 0 or less is not significant."""
    return [lam * s - log_k - math.log(max(n, 1)) for _, _, s in parts]


def evidence(values: list[float]) -> float:
    return math.log1p(sum(max(0.0, v) for v in values))


def _count(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Texts of either kind that hold a token; a token that one text repeats counts once."""
    counts = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["token", "toxic", "clean"])
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[int(toxic > 0)].update(set(tokens(text)))
            if len(counts[0]) + len(counts[1]) > most:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def sampled_labels(labels: DataFrame, training: Column, most: int) -> DataFrame:
    """At most ``most`` labelled training rows, those with the least hashes; one label per doc_id."""
    rows = labels.filter(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return least_hashed(rows, F.xxhash64("doc_id", F.lit(17)), [F.col("doc_id")], most, rows.count())


def fit(docs: DataFrame, labels: DataFrame, training: Column, max_rows: int = 20_000, kappa: float = 4.0, z_least: float = 3.5) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which ``training`` (an expression over doc_id) holds.

    All words of these rows whose log-odds are significant make up the model,
    so ``max_rows`` bounds it; no word is left out for its number.
    """
    spark = docs.sparkSession
    kept = [(r.doc_id, int(r.toxic)) for r in sampled_labels(labels, training, max_rows).collect()]
    picked = F.broadcast(spark.createDataFrame(kept, "doc_id long, toxic int"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    # Copies of one text are one observation.
    sample = sample.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("row")).select("row.text", "row.toxic")
    counts = sample.mapInArrow(_count, "token binary, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = counts.persist()
    all_t, all_c = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not all_t or not all_c:
        counts.unpersist()
        share = sum(t for _, t in kept) / max(1, len(kept))
        return Model({}, {}, -1e-3, 1.0, 0.0, (math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0))
    base_t, base_c = all_t / (all_t + all_c), all_c / (all_t + all_c)
    stem = F.substring("token", 1, STEM)
    stems = counts.groupBy(stem.alias("stem")).agg(F.sum("t").alias("st"), F.sum("c").alias("sc"))
    odds = lambda t, c: F.log(t / F.lit(all_t)) - F.log(c / F.lit(all_c))
    prior_t, prior_c = F.lit(kappa * base_t), F.lit(kappa * base_c)
    stems = stems.withColumns({"pt": F.col("st") + prior_t, "pc": F.col("sc") + prior_c})
    stems = stems.withColumns({"so": odds(F.col("pt"), F.col("pc")), "sz": odds(F.col("pt"), F.col("pc")) / F.sqrt(1 / F.col("pt") + 1 / F.col("pc"))})
    # Words score under their stem's prior; their significance is told by the corpus prior alone.
    words = counts.withColumn("stem", stem).join(stems, "stem")
    a, b = F.col("t") + kappa * F.col("pt") / (F.col("pt") + F.col("pc")), F.col("c") + kappa * F.col("pc") / (F.col("pt") + F.col("pc"))
    flat_t, flat_c = F.col("t") + prior_t, F.col("c") + prior_c
    words = words.withColumns({"wo": odds(a, b), "wz": odds(flat_t, flat_c) / F.sqrt(1 / flat_t + 1 / flat_c)})
    strong = words.filter((F.abs("wz") >= z_least) & (F.signum("wo") == F.signum("wz"))).select("token", "stem", "wo", "t", "c", "so", "sz").orderBy("token").collect()
    counts.unpersist()
    table = {bytes(r.token): r.wo for r in strong}
    mass_t, mass_c = sum(r.t for r in strong) / all_t, sum(r.c for r in strong) / all_c
    rest = lambda mass, share: math.log(max(0.0, 1 - mass) + kappa * share)
    default = min(-1e-4, rest(mass_t, 1 / all_t) - rest(mass_c, 1 / all_c))
    # A stem speaks for words never met only if it is significant itself; else they belong to the class of the rest.
    by_stem = {bytes(r.stem): (r.so if abs(r.sz) >= z_least else default) for r in strong}
    # Under clean text a word comes as often as clean rows have it, smoothed as its score is.
    spread = [((r.c + kappa * base_c * math.exp(-max(r.wo, 0.0))) / all_c, r.wo) for r in strong]
    lam = _decay(spread, default)
    scanned = written(sample.mapInArrow(lambda it: _scanned(it, table, by_stem, default), "toxic int, n long, found array<double>"), "toxic-scans")
    # Best scores of n clean tokens follow P(S < x) = exp(-K n exp(-lam x)); this is the K of greatest likelihood.
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    clean, mass = scanned.filter("toxic = 0").agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.exp(-lam * best)), F.lit(0.0))).first()
    log_k = math.log((1 + clean) / (1 + mass))
    beyond = F.transform("found", lambda s: F.greatest(F.lit(0.0), lam * s - log_k - F.log(F.greatest("n", F.lit(1)).cast("double"))))
    seen = scanned.select(F.log1p(F.aggregate(beyond, F.lit(0.0), lambda a, v: a + v)).alias("x"), "toxic").collect()  # two numbers for each of max_rows rows at most
    return Model(table, by_stem, default, lam, log_k, _calibrate(np.array([r.x for r in seen]), np.array([float(r.toxic) for r in seen])))


def _decay(spread: list[tuple[float, float]], default: float) -> float:
    """The positive root of E[exp(lam * score)] = 1 over clean tokens."""
    rest = max(0.0, 1 - sum(p for p, _ in spread))
    total = lambda lam: rest * math.exp(lam * default) + sum(p * math.exp(min(700.0, lam * s)) for p, s in spread)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    return max(0.05, lo)


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression by Newton steps."""
    design, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (p - y) + ridge * w)
    return float(w[0]), float(w[1])


def _scanned(batches: Iterator[pa.RecordBatch], words: dict, stems: dict, default: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [scan(t, words, stems, default) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in p] for _, p in got], pa.list_(pa.float64()))], names=["toxic", "n", "found"])


def chance(found: list[float], weights: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] + weights[1] * evidence(found)))))


def _score(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            n, parts = scan(text, m.words, m.stems, m.default)
            found = significances(n, parts, m.lam, m.log_k)
            p = chance(found, m.weights)
            passages = [{"start": a, "length": b - a, "score": s, "significance": v} for (a, b, s), v in zip(parts, found) if v > 0]
            rows.append((p, int(p >= 0.5), n, len(passages), passages))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int32(), PASSAGES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "score", "predicted", "n_tokens", "n_passages", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text), with every significant passage as (start, length) in tokens, score and significance.

    Texts of any length are scanned whole, in one pass. Null and empty texts have no passage and get the score of a text without
    toxic tokens. Repeated rows are scored one by one, a null doc_id stays null,
    extra columns are ignored, an empty table gives no rows. Without labels of
    both kinds the score is the share of toxic labels for all.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, handle.value), SCORES)


def civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (text) whose text is not predicted toxic, with all their columns.

    Null and empty texts have no passage and stay, unless most labels are toxic;
    repeated rows stay or go together, an empty table gives no rows.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        m = handle.value
        scans = (scan(t, m.words, m.stems, m.default) for t in texts)
        return pd.Series([chance(significances(n, parts, m.lam, m.log_k), m.weights) for n, parts in scans], dtype="float64")

    return docs.filter(toxic(F.col("text").cast("string")) < 0.5)
