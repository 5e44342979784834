import zlib

import pandas as pd
from pyspark.sql import functions as F

from shoplake.llm.sharding import Leaf, assign, even_tree, grown
from tests.llm.common import awkward, empty


def test_slots_sizes_and_checksums(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), awkward(spark).withColumn("bucket", F.lit(1)).withColumn("shard", F.lit("x"))):
        local = docs.select("doc_id", "text").toPandas()
        got = assign(docs, even_tree(8), grown(even_tree(8), 1, 3, 8), slot_buckets=7).toPandas()
        assert len(got) == len(local)
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        key = lambda d, s, c: sorted(zip(d.fillna(-1), s, c))
        text = local["text"].map(lambda t: (t if isinstance(t, str) else "").encode())
        assert key(got["doc_id"], got["size"], got["text_crc32"]) == key(local["doc_id"], text.map(len) + 1, text.map(zlib.crc32))
    assert assign(empty(spark), even_tree(8), grown(even_tree(8), 1, 3, 8)).count() == 0


def test_growth_moves_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = even_tree(3)
    for n, (region, rack) in enumerate([(0, 0), (0, 1), (2, 5), (0, 0), (1, 3)], 3):
        more = grown(tree, region, rack, n)
        got = assign(docs, tree, more).select("shard", "grown_shard").toPandas()
        moved = got[got["shard"] != got["grown_shard"]]
        assert (moved["grown_shard"] == n).all() and abs(len(moved) - 20_000 / (n + 1)) < 800
        assert got["grown_shard"].value_counts().between(20_000 / (n + 1) - 800, 20_000 / (n + 1) + 800).all()
        tree = more


def brute_place(key, tree):
    """The same races over Python's own xxhash: the least draw among generations, then regions, racks and shards."""
    from math import log

    from xxhash import xxh64_intdigest

    def h(path):  # Spark's hash of (long, string): the first value's hash seeds the second's
        first = xxh64_intdigest(key.to_bytes(8, "little"), 42)
        return xxh64_intdigest(path.encode(), first)

    draw = lambda path, w: -log(((h(path) & (1 << 53) - 1) + 1) / float(1 << 53)) / w
    total = lambda xs: sum(x.weight for x in xs)
    parts = {g: [x for x in tree if x.generation == g] for g in {x.generation for x in tree}}
    g = min(parts, key=lambda g: draw(f"generation {g}", total(parts[g])))
    left = parts[g]
    r = min({x.region for x in left}, key=lambda r: draw(f"{g}/{r}", total(x for x in left if x.region == r)))
    left = [x for x in left if x.region == r]
    k = min({x.rack for x in left}, key=lambda k: draw(f"{g}/{r}/{k}", total(x for x in left if x.rack == k)))
    return min((x for x in left if x.rack == k), key=lambda x: draw(f"{g}/{r}/{k}/{x.shard}", x.weight)).shard


def test_shards_by_brute_force(spark):
    tree = grown(grown([Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 2.5), Leaf(0, 1, 2, 1.0), Leaf(3, 2, 3, 4.0), Leaf(3, 7, 9, 0.5)], 0, 0, 4, 2.0), 5, 5, 5)
    docs = spark.range(3000).select((F.col("id") * 7919).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert {r.doc_id: r.shard for r in assign(docs, tree).collect()} == {7919 * i: brute_place(7919 * i, tree) for i in range(3000)}


def test_rows_of_one_key_are_dealt(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = assign(docs, even_tree(8), slot_buckets=16).toPandas()
    assert got["shard"].nunique() == 1 and sorted(got["slot"]) == list(range(5000))


def test_weights_and_confined_movement(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 2.0), Leaf(0, 1, 2, 1.0), Leaf(1, 2, 3, 4.0)]
    heavier = [x._replace(weight=3.0) if x.shard == 1 else x for x in tree]
    got = assign(docs, tree, heavier).toPandas()
    share = got["shard"].value_counts(normalize=True)
    for leaf in tree:
        assert abs(share[leaf.shard] - leaf.weight / 8) < 0.02
    # Only subtrees whose weight changed gain: shard 1 in its rack, the rack in its region, the region.
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(zip(moved["shard"], moved["grown_shard"])) == {(0, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}
    # The same weight as a generation of its own takes documents into shard 1 alone.
    got = assign(docs, tree, grown(tree, 0, 0, 1)).toPandas()
    assert set(got.loc[got["shard"] != got["grown_shard"], "grown_shard"]) == {1} and abs((got["grown_shard"] == 1).mean() - 3 / 9) < 0.02
    assert isinstance(got, pd.DataFrame)
