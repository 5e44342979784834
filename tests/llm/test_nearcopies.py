import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shoplake.llm import nearcopies
from tests.llm.common import awkward, empty


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_least(texts):
    """Place of each text to the least place of its group."""
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def edited():
    """Texts with copies of which a word or some were changed, moved or cut, about a passage that all share."""
    rng = random.Random(11)
    shared = [f"license{i}" for i in range(40)]
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 90, 250, 900]))] + shared * (g % 2)
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(words[: len(words) - (edits == 3)]))
    return texts


@pytest.mark.parametrize("common", [None, []])
def test_edited_copies_by_brute_force(spark, common, tmp_path, monkeypatch):
    if common is not None:
        monkeypatch.setattr(nearcopies, "_common", lambda *a: nearcopies.np.array(common, dtype="int64"))
    texts = edited()
    least = brute_least(texts)
    assert len(set(least)) < len(set(texts)) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {r.node for r in nearcopies.copies(docs).collect()}
    assert got == {i for i, c in enumerate(least) if c != i}


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 5, 511, 512, 513, 3000, 20_000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        for share, m in ((0.9, n), (0.5, 2 * n), (0.0, n // 3 + 1)):
            b = np.unique(np.r_[a[: int(share * len(a))], rng.integers(-(2**63), 2**63, m - int(share * len(a)) if m > int(share * len(a)) else 0)])
            apart = len(np.setxor1d(a, b))
            got = nearcopies.differing(nearcopies.parity(a), nearcopies.parity(b))
            assert got <= apart and got == nearcopies.differing(nearcopies.parity(b), nearcopies.parity(a))
            assert share > 0 or n < 600 or m < n or got > 0.3 * n  # as sharp for long documents


def test_parity_bits_where_keys_meet_lose_no_pair():
    texts = edited()
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["node", "text"])
    rows = [r for b in nearcopies._prefixes(iter([docs]), 5, 0.8, np.empty(0, np.int64)) for r in b.to_pylist()]
    assert any(r[c] < 0 for r in rows for c in nearcopies.FOLDED)
    met = sorted((key, r["node"], r["n"], pos, r["node"], *[r[c] for c in nearcopies.FOLDED]) for r in rows for pos, key in enumerate(r["head"]))
    names = ["key", "node", "n", "pos", "grp", *nearcopies.FOLDED]
    table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*met)], names=names)
    pairs = lambda columns: {(r["u"], r["v"]) for b in nearcopies._candidates(iter([table.select(columns)]), 0.8, None) for r in b.to_pylist()}
    got, sets = pairs(names), [shingles(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near and near <= got < pairs(names[:5])


def test_stage_drops_edited_copies(spark, tmp_path):
    texts = edited()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = dict(cp.STAGES)["SimHash near-dedup"](spark, spark.read.parquet(str(tmp_path / "docs")), "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(brute_least(texts)))


def test_edge_rows(spark):
    docs = awkward(spark).withColumn("node", F.monotonically_increasing_id()).select("node", "text").toPandas().sort_values("node")
    least = brute_least(list(docs["text"]))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs["text"])], "node long, text string")
    assert {r.node for r in nearcopies.copies(frame).collect()} == {i for i, c in enumerate(least) if c != i}
    assert nearcopies.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("cores", [3, 7])
def test_rows_stay_themselves_when_cores_change(spark, tmp_path, cores):
    """Files are split by the number of cores, which may change between the call and the action."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumns({"node": F.lit(1), "whole": F.lit("clash")})
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    from shoplake.llm.decontam import clean, contaminated

    rows = spark.read.parquet(str(tmp_path / "docs"))
    leaks = {r.doc_id for r in contaminated(rows, bench).collect()}
    least = brute_least([t for _, t in sorted((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect())])
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
        left, each = clean(rows, bench), nearcopies.one_of_each(rows)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(20 - cores))
        assert left.columns == each.columns == rows.columns
        assert {r.doc_id for r in left.collect()} == {r.doc_id for r in rows.collect()} - leaks
        assert each.count() == len(set(least))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_columns_that_clash(spark):
    texts = edited()[:40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).withColumns({c: F.lit("clash") for c in ("node", "whole", "u", "v", "digest", "n", "head", "bits", "fp", "p0")})
    got = nearcopies.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(brute_least(texts)))
