import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplake.llm.queries import fold, op5_toxic_segments
from shoplake.llm.toxicity import Model, fit, score, segments
from tests.llm.common import awkward, empty


def brute_segments(values):
    """Recursive definition: the best segment, then those left and right of it."""
    best = max(((sum(values[i:j]), -(j - i), -i) for i, j in itertools.combinations(range(len(values) + 1), 2)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [(a, b) for a, b in brute_segments(values[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(values[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        at = sorted(rng.sample(range(14), rng.randrange(0, 8)))
        own = [rng.choice([0.73, 1.91, 3.17, -0.4, -2.3]) * rng.uniform(0.9, 1.1) for _ in at]
        values = [-0.61] * 14
        for i, s in zip(at, own):
            values[i] = s
        got = [(a, b) for a, b, _ in segments(at, own, -0.61)]
        assert got == brute_segments(values)


def toks(text):
    return "".join(c for c in text.lower() if not (33 <= ord(c) < 127 and not c.isalnum())).split()


def brute_scores(texts, labelled, kappa=4.0, z_least=3.5):
    """The whole model in plain Python: {id: (score, significant passages)} of ``texts`` learnt from ``labelled`` {id: toxic}."""
    once = {}
    for d in sorted(labelled):
        once.setdefault(texts[d], labelled[d])
    t, c = Counter(), Counter()
    for text, toxic in once.items():
        (t if toxic else c).update(set(toks(text)))
    all_t, all_c = sum(t.values()), sum(c.values())
    pt, pc = kappa * all_t / (all_t + all_c), kappa * all_c / (all_t + all_c)
    odds = lambda x, y: math.log(x / all_t) - math.log(y / all_c)
    z = lambda x, y: odds(x, y) / math.sqrt(1 / x + 1 / y)
    st, sc = Counter(), Counter()
    for w in t.keys() | c.keys():
        st[w[:5]] += t[w]
        sc[w[:5]] += c[w]
    own = {}
    for w in t.keys() | c.keys():
        x, y = st[w[:5]] + pt, sc[w[:5]] + pc
        o, sure = odds(t[w] + kappa * x / (x + y), c[w] + kappa * y / (x + y)), z(t[w] + pt, c[w] + pc)
        if abs(sure) >= z_least and o * sure > 0:
            own[w] = o
    left = lambda n, k: math.log(1 - sum(n[w] for w in own) / k + kappa / k)
    rest = min(-1e-4, left(t, all_t) - left(c, all_c))
    stems = {w[:5]: odds(st[w[:5]] + pt, sc[w[:5]] + pc) if abs(z(st[w[:5]] + pt, sc[w[:5]] + pc)) >= z_least else rest for w in own}
    value = lambda w: own.get(w, stems.get(w[:5], rest))
    share = {w: (c[w] + pc * math.exp(-max(o, 0))) / all_c for w, o in own.items()}
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        lam = (lo + hi) / 2
        mean = max(0, 1 - sum(share.values())) * math.exp(lam * rest) + sum(share[w] * math.exp(lam * own[w]) for w in own)
        lo, hi = (lam, hi) if mean < 1 else (lo, lam)
    lam = max(0.05, lo)

    def parts(text):
        values = [value(w) for w in toks(text)]
        return len(values), [(a, b, sum(values[a:b])) for a, b in brute_segments(values)]

    clean = [parts(text) for text, toxic in once.items() if not toxic]
    log_k = math.log((1 + len(clean)) / (1 + sum(n * math.exp(-lam * max((s for *_, s in p), default=0)) for n, p in clean)))

    def found(text):
        n, p = parts(text)
        return [(a, b - a, s, lam * s - log_k - math.log(max(n, 1))) for a, b, s in p]

    x = np.array([math.log1p(sum(max(0, v) for *_, v in found(text))) for text in once])
    y, w = np.array(list(once.values())), np.zeros(2)
    for _ in range(200):  # plain Newton steps of the ridge logistic regression
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        d = np.c_[np.ones(len(x)), x]
        w = w - np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), d.T @ (p - y) + 0.01 * w)
    return {d: (1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(sum(max(0, v) for *_, v in found(t)))))), [q for q in found(t) if q[3] > 0]) for d, t in texts.items()}


def test_scores_and_passages_by_brute_force(spark):
    rng = random.Random(5)
    calm, plain, nasty = [f"calm{i}" for i in range(8)], [f"w{i}" for i in range(300)], [f"nastyword{i}" for i in range(6)] + ["vile!"]
    texts = {}
    for d in range(260):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        if d % 4:
            words += calm
        elif d % 12 == 0:  # two passages with what clean texts hold between them
            words += [*rng.choices(nasty, k=4), *(calm * 6), *rng.choices(nasty, k=4)]
        else:
            words[2:2] = rng.choices(nasty, k=6)
        texts[d] = " ".join(words)
    texts |= {258: texts[0], 259: "nastyword99 calm3", 257: ""}
    labelled = {d: int(d % 4 == 0) for d in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, t in labelled.items()], "doc_id long, toxic int")
    want = brute_scores(texts, labelled)
    got = score(docs, fit(docs, labels, F.lit(True))).collect()
    assert any(len(want[d][1]) > 1 for d in want) and len(got) == 260
    for r in got:
        p, passages = want[r.doc_id]
        assert r.score == pytest.approx(p, abs=1e-6) and r.n_passages == len(passages)
        assert [(q.start, q.length) for q in r.passages] == [q[:2] for q in passages]
        assert [(q.score, q.significance) for q in r.passages] == [pytest.approx(q[2:], abs=1e-6) for q in passages]


def test_held_out_labels_are_met(spark):
    d = "/root/testdata/sf0.01"
    got = op5_toxic_segments(spark, d).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    both = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.85
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.1


def test_awkward_rows_and_no_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = fit(spark.read.parquet(f"{d}/documents.parquet"), labels, fold(5) != 0)
    docs = awkward(spark).withColumn("score", F.lit("clash"))
    assert score(docs, model).count() == docs.count()
    assert score(empty(spark), model).count() == 0
    nothing = fit(docs, labels.limit(0), fold(5) != 0)
    assert isinstance(nothing, Model) and score(docs, nothing).select("score").distinct().count() == 1
