import random

import numpy as np
import xxhash

from shoplake.llm.simhash import links, near_duplicates, trie_pairs
from tests.llm.common import awkward, empty


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    comp = dict.fromkeys(prints)
    ids = sorted(prints)
    for i in ids:
        if comp[i] is None:
            comp[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for y in ids:
                    if comp[y] is None and (prints[x] ^ prints[y]).bit_count() <= 2:
                        comp[y] = i
                        todo.append(y)
    return comp


def test_matches_brute_force(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark).filter("doc_id is not null")):
        local = docs.select("doc_id", "text").toPandas()
        prints = {int(d): brute_print(t) for d, t in zip(local["doc_id"], local["text"])}
        comp = brute_components(prints)
        got = near_duplicates(docs).toPandas()
        assert len(got) == len(local)
        for r in got.itertuples():
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == comp[r.doc_id]


def test_edge_tables(spark):
    assert near_duplicates(empty(spark)).count() == 0
    got = near_duplicates(awkward(spark)).toPandas()
    assert len(got) == awkward(spark).count()
    assert set(got.loc[got["doc_id"].isna(), "component_id"]) == {4}


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(200)]
    prints = sorted({b ^ m for b in base for m in [0, *(1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in range(6)), rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)]})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    reps = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long")
    from shoplake.llm.components import components

    got = dict(components(links(reps, 2)).collect())
    want = brute_components(dict(enumerate(prints)))
    assert {i: got.get(i, i) for i in range(len(prints))} == want


def test_trie_walk_is_exact_in_small_frontiers():
    rng = np.random.default_rng(3)
    values = np.unique(np.r_[rng.integers(0, 1 << 63, 50, dtype=np.uint64), np.arange(70, dtype=np.uint64)])
    got = sorted((min(a, b), max(a, b)) for i, j in trie_pairs(values, 2, 0, most=8) for a, b in zip(i.tolist(), j.tolist()))
    want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2]
    assert got == want


def test_columns_that_clash(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark)
    more = docs.withColumns({c: F.lit("clash") for c in ("fp", "node", "u", "v", "component", "fingerprint", "component_id", "rid")})
    shown = lambda d: sorted(map(str, near_duplicates(d).select("doc_id", "fingerprint", "component_id").collect()))
    assert shown(more) == shown(docs)
