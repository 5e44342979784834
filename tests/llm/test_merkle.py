import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shoplake.llm import merkle
from tests.llm.common import DOCS, awkward, empty


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def climb(hashes, fanout):
    """(root, path of each as (left, right) by level)."""
    paths, places = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(places):
            run = p // fanout * fanout
            paths[i].append(("".join(hashes[run:p]), "".join(hashes[p + 1 : run + fanout])))
            places[i] = p // fanout
        hashes = [h(*hashes[i : i + fanout]) for i in range(0, len(hashes), fanout)]
    return hashes[0], paths


def brute(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    low = {g: climb([leaf(r, r.text) for r in groups[g]], fanout) for g in names}
    root, tops = climb([low[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for r, path in zip(groups[g], low[g][1]):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            f = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if bad else r.text)
            for a, b in path + top:
                f = h(a, f, b)
            out.append((r.doc_id, leaf(r, r.text), low[g][0], root, h(*[a + b for a, b in path + top]), f, f == root))
    return sorted(out, key=str)


def audited(docs, fanout=8):
    got = merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fanout=fanout)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 8])
def test_awkward_rows(spark, fanout):
    docs = awkward(spark)
    assert audited(docs.withColumn("hash", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("n", F.lit(0)), fanout) == brute(docs.collect(), fanout)


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert audited(docs) == brute(docs.collect())


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (64, 1), (65, 8, 2), (1,) * 10, (513, 1, 1)])
def test_shapes(spark, sizes):
    rows = [(g * 1000 + i, f"Text {i}", None if g == 3 else f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert audited(docs) == brute(docs.collect())


def test_empty_table_and_build(spark):
    assert merkle.build(empty(spark)).root is None and audited(empty(spark)) == []
    docs = awkward(spark)
    found = merkle.build(docs)
    assert found.subroots.agg(F.sum("leaves")).first()[0] == docs.count()
    assert {r.f for r in found.leaves.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f")).collect()} == {found.root}
