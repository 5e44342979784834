import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplake.llm.decontam import MASKS, best_stretch, clean, contaminated, seed_hits
from tests.llm.common import awkward, empty


def vocabulary(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(400)}" for _ in range(n)]


def test_planted_passages_with_substitutions(spark):
    rng = random.Random(7)
    items = [(i, " ".join(vocabulary(i, 20 + i))) for i in range(12)] + [(90, None), (91, ""), (92, "Lone four word item"), (93, items_upper := "ÉTÉ ñandú über alles in der kleinen Welt am See und im Wald")]
    docs, want = [], set()
    for d in range(120):
        words = vocabulary(1000 + d, 300)
        if d % 3 == 0:
            item = d % 12
            part = items[item][1].split()
            for i in range(d % 5, len(part), 7):
                part[i] = f"swap{rng.randrange(9999)}"
            at = rng.randrange(250)
            words[at:at] = [w.upper() + rng.choice([",", "", "."]) for w in part]
            want.add((d, item))
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "so a lone FOUR word item."), (503, items_upper.lower()), (503, items_upper.lower())]
    want |= {(502, 92), (503, 93)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = contaminated(d, b).toPandas()
    assert set(zip(one["doc_id"], one["item_id"])) == want and (one["doc_id"] == 503).sum() == 2
    assert sorted(map(tuple, one.to_numpy().tolist())) == sorted(brute(docs, items))


def toks(text):
    return "".join(c for c in (text or "").lower() if not (33 <= ord(c) < 127 and not c.isalnum())).split()


def brute(docs, items, least=10, penalty=2):
    """Every diagonal of every document and item that some mask hits, compared word by word."""
    out = []
    for doc_id, doc in docs:
        words = toks(doc)
        for item_id, item in sorted(set(items), key=str):
            test, best = toks(item), None
            masks = ["1" * len(test)] if 0 < len(test) < 8 else MASKS
            for shift in range(-len(test) + 1, len(words)):
                lo, hi = max(0, -shift), min(len(test), len(words) - shift)
                value = [1 if test[j] == words[j + shift] else -penalty for j in range(lo, hi)]
                if value.count(1) < min(len(test), 5):
                    continue
                hits = 0
                for mask in masks:
                    picked = [i for i, bit in enumerate(mask) if bit == "1"]
                    hits += sum(all(test[j + i] == words[j + shift + i] for i in picked) for j in range(lo, hi - len(mask) + 1))
                if not hits:
                    continue
                sums = [0, *np.cumsum(value).tolist()]
                gain, end = max(((sums[e] - min(sums[: e + 1]), -e) for e in range(len(sums))))
                end = -end
                start = sums[: end + 1].index(min(sums[: end + 1]))
                if gain >= min(least, max(1, int(0.8 * len(test)))):
                    matched = sum(v == 1 for v in value[start:end])
                    got = (gain, lo + shift + start, lo + start, end - start, matched, len(test), hits)
                    best = max(best or got, got)
            if best:
                out.append((doc_id, item_id, *best[1:]))
    return out


@pytest.mark.parametrize("bits", [8, 26])
def test_rows_by_brute_force(spark, bits):
    """Repeats, substitutions, cut and overlapping passages out of few words; a full bitmap lets all windows through and changes nothing."""
    rng = random.Random(3)
    items = [(i, " ".join(vocabulary(i, rng.choice([3, 7, 8, 15, 30])))) for i in range(9)]
    items += [(0, items[5][1]), (20, items[6][1]), (20, items[6][1])]
    docs = []
    for d in range(40):
        words = vocabulary(500 + d, 60)
        for _ in range(rng.choice([0, 1, 2, 3])):
            part = rng.choice(items)[1].split()
            part = part[rng.randrange(3) :]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((d, " ".join(words)))
    clash = {"item_id": F.lit(1), "words": F.lit("x"), "rid": F.lit(2), "seeds": F.lit(3), "shift": F.lit(4)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rid": F.lit(1)})
    got = [tuple(r) for r in contaminated(d, b, bits=bits).collect()]
    assert sorted(got) == sorted(brute(docs, items)) and len(got) > 20


def test_every_full_passage_is_found_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(i in flat(r.text) for i in items)}
    got = {r.doc_id for r in contaminated(docs, bench).collect()}
    assert want == got


def test_edge_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "a b c"), (2, "alpha, beta gamma delta"), (None, "w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12"), (3, "   ")], "item_id long, text string")
    assert contaminated(empty(spark), bench).count() == 0
    assert contaminated(awkward(spark), bench.limit(0)).count() == 0
    docs = awkward(spark).withColumns({"rid": F.lit(1), "whole_row": F.lit("clash"), "words": F.lit("x")})
    got = sorted(((r.doc_id, r.item_id, r.doc_start, r.length) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(3, None, 12704, 10), (4, 2, 0, 4), (4, 2, 0, 4), (4, 2, 0, 4), (5, 2, 0, 4), (6, 2, 0, 4), (None, 2, 0, 4)], key=str)
    docs.write.parquet(str(tmp_path / "docs"))
    left = clean(spark.read.parquet(str(tmp_path / "docs")), bench)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([0, 1, 2, 7, 8, 9, 77], key=str)
    assert clean(spark.read.parquet(str(tmp_path / "docs")), bench.limit(0)).count() == docs.count()


def test_repeated_words(spark):
    """Every window equals every other: counted along diagonals, not pair by pair."""
    word = lambda n: " ".join(["again"] * n)
    docs = [(1, word(300)), (2, "x " + word(37) + " y " + word(12)), (3, "a b " * 80), (4, word(9))]
    items = [(1, word(25)), (2, "a b " * 9), (3, word(60) + " other"), (4, "again again again")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in contaminated(d, b).collect()) == sorted(brute(docs, items))


def test_a_very_long_text_of_one_word():
    n, m = 400_000, 400
    words, test = np.full(n, 7, dtype=np.uint64), np.full(m, 7, dtype=np.uint64)
    seeds_ = [np.full(k - len(mask) + 1, i, dtype=np.int64) for k in (n, m) for i, mask in enumerate(MASKS)]
    at = [np.arange(len(x)) for x in seeds_]
    mine, mine_at, other, other_at = (np.concatenate(x) for x in (seeds_[:3], at[:3], seeds_[3:], at[3:]))
    hits = seed_hits(mine, mine_at, other, other_at, m, n + m, most=1_000_000)
    assert hits[m] == hits[n] == sum(m - len(mask) + 1 for mask in MASKS) and hits[0] == 0
    got = best_stretch(words, test, hits, 10, 2)
    assert got == (m, n - m, 0, m, m, m, hits[m])
