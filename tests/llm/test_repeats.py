import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplake.llm.repeats import merged, without_repeats
from shoplake.llm.suffixes import earlier, suffix_array
from tests.llm.common import DOCS, awkward, empty


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_suffixes_are_sorted(letters):
    rng = random.Random(letters)
    for _ in range(400):
        text = [rng.randrange(letters) for _ in range(rng.randrange(45))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_windows_of_aligned_slices():
    rng, width, gram = random.Random(2), 12, 4
    for _ in range(300):
        rows = []
        for g in range(rng.randrange(1, 4)):
            core, pool = bytes(rng.choice(b"ab") for _ in range(gram)), [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(3)]
            for _ in range(rng.randrange(1, 8)):
                a, b = rng.randrange(9), rng.randrange(9)
                s = rng.choice(pool)[8 - a :] + core + rng.choice(pool)[:b]
                if len(s) >= width and len(s) - width <= a and a + gram <= width:
                    rows.append((g, s, a))
        if not rows:
            continue
        _, group = np.unique([r[0] for r in rows], return_inverse=True)
        rank = list(range(len(rows)))
        rng.shuffle(rank)
        got = sorted(zip(*(x.tolist() for x in earlier(group, [r[1] for r in rows], np.array([r[2] for r in rows]), np.array(rank), width))))
        holds = lambda j, back, w: rows[j][2] >= back and rows[j][1][rows[j][2] - back :][:width] == w
        want = [(i, at) for i, (g, s, a) in enumerate(rows) for at in range(len(s) - width + 1) if any(group[j] == group[i] and rank[j] < rank[i] and holds(j, a - at, s[at : at + width]) for j in range(len(rows)))]
        assert got == want


def test_spans_that_touch_are_one():
    got = merged(np.array([1, 1, 1, 0, 1]), np.zeros(5, dtype=np.int64), np.array([5, 0, 9, 0, 30]), np.array([9, 6, 12, 4, 31]))
    assert [x.tolist() for x in got] == [[0, 1, 1], [0, 0, 0], [0, 0, 30], [4, 12, 31]]


def brute(rows, length=100):
    """Rows (doc_id, text), equal ones in any order, as the operator orders them."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if (w := data[p : p + length]) in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), sum(bool(g) and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_tables_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert results(without_repeats(docs)) == brute(sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("most", [2, 1_000])
def test_hard_texts_against_brute_force(spark, most):
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("etaoin shrdlu\n") for _ in range(n))
    line, long = prose(95), prose(400)
    texts = ["a" * 1500, "b" + "a" * 700, "ab" * 300, "xab" * 200 + "ab" * 90, "", "short", long, long[:99], long[50:151], "ç漢" * 90, "z" + "ç漢" * 90]
    texts += [prose(rng.randrange(60)) + line + prose(rng.randrange(60)) for _ in range(40)]  # one passage of less than a window, and near it
    texts += [prose(30) + long[i : i + rng.randrange(90, 200)] + prose(30) for i in range(0, 200, 9)]
    texts += [prose(5_000), (one := prose(150)) + prose(270_000) + one + prose(40)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("doc", F.lit("clash")).withColumn("th", F.lit(1)).withColumn("spans", F.lit(2))
    assert results(without_repeats(docs, most=most)) == brute([r[:2] for r in rows])


def test_other_lengths(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(60)), None, None, None) for i in range(30)]
    assert results(without_repeats(spark.createDataFrame(rows, DOCS), length=9)) == brute([r[:2] for r in rows], 9)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert without_repeats(empty(spark)).count() == 0
    local = [(r.doc_id, r.text) for r in docs.collect()]
    assert results(without_repeats(docs)) == brute(sorted(local, key=lambda r: (r[0] is not None, r[0] or 0)))
    again = docs.unionByName(docs)
    local = sorted(local * 2, key=lambda r: (r[0] is not None, r[0] or 0))
    assert results(without_repeats(again)) == brute(local)
    whole = {r.doc_id: r for r in without_repeats(docs, keep=True).collect()}
    assert bytes(whole[77].kept) == b"lone" and hashlib.sha256(whole[3].kept).hexdigest() == whole[3].kept_sha256
