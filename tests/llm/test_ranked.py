import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplake.llm import ranked
from tests.llm.common import DOCS, LONG, awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(d, Counter(ws), len(ws)) for d, t in docs if (ws := words(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(words(text)) if df[t]}
        found = []
        for d, c, size in held:
            m = 50 + 50 * size * n // total
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in w if t in c)
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def got(docs, items, k=50):
    return sorted((tuple(r) for r in ranked.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = "item_id long, text string, doc string, s long"


@pytest.mark.parametrize("k", [1, 3, 50])
def test_random_texts(spark, k):
    rng = random.Random(k)
    vocabulary = [f"t{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60)), None, None, None) for i in range(400)]
    items = [(i, text(rng.randrange(1, 15)), None, None) for i in range(12)] + [(40, "absent words", None, None), (41, "t0 T0 t0", None, None), (42, None, None, None), (43, "", None, None), (41, "t1", None, None), (41, "t1", None, None)]
    docs, asked = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute([r[:2] for r in rows], [x[:2] for x in items], k)
    assert got(docs, asked, k) == want


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("s", F.lit(1)).withColumn("batch", F.lit("x")).withColumn("query", F.lit(None))
    items = [(1, "ALPHA beta", None, None), (2, "w5x5 ça 漢字 re 12345", None, None), (None, "gamma", None, None), (3, LONG, None, None)]
    asked = spark.createDataFrame(items, ITEMS)
    assert got(docs, asked) == brute([(r.doc_id, r.text) for r in docs.collect()], [x[:2] for x in items])
    assert got(empty(spark), asked) == [] and got(docs, asked.limit(0)) == []


def test_batches_and_bounds(spark, sf):
    """Batches of few documents: many blocks of a list, bounds that rule documents out."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert got(docs.repartition(7), items, 5) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)
