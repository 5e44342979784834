import math

import pytest
from pyspark.sql import functions as F

from shoplake.operators.basket import association_rules, pair_counts, product_affinity
from shoplake.recs import factors, hybrid
from shoplake.sources import files, schemas


def test_files_round_trip(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "payments.csv").write_text('payment_id,order_id,payment_date,payment_method,payment_status,amount,gateway,transaction_ref\n1,1,2024-01-01,"a, ""b""",NULL,5,null,\n')
    (raw / "orders.csv").write_text("a,b\n1,2\n")
    counts = files.ingest_csv_to_parquet(spark, str(raw), str(tmp_path / "out"), ("payments", "reviews"))
    assert counts == {"payments": 1}
    (r,) = files.read_parquet(spark, str(tmp_path / "out/payments")).collect()
    assert r.payment_method == 'a, "b"' and r.payment_status is None and r.gateway is None and r.transaction_ref is None
    with pytest.raises(Exception):  # noqa: B017 - an alien file fails the read
        files.read_stage_csv(spark, str(raw / "orders.csv"), schemas.PAYMENTS).collect()
    meta = files.with_load_metadata(spark.read.parquet(str(tmp_path / "out/payments"))).first()
    assert meta["_source_file"].endswith(".parquet") and meta["_row_number"] == 0
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert files.read_stage_json(spark, str(tmp_path / "a.json"), "k int").count() == 2
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, order_date string")
    files.write_parquet(df, str(tmp_path / "p"), "order_date")
    files.refresh_table(df.filter("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "p"), "order_date", dynamic=True)
    assert {r.v for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {1, 9}
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_incremental_load(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "a int, b string", str(tmp_path / "t"), str(tmp_path / "ck"))
    (src / "1.csv").write_text("a,b\n1,x\nbad,y\n")
    files.load_new_files(*args)
    (src / "2.csv").write_text("a,b\n2,z\n")
    files.load_new_files(*args)
    files.load_new_files(*args)
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "t/rows/load=*")).collect()) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "t/bad/load=*")).count() == 1


def test_baskets(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "c"), (5, "c"), (5, "a")]
    items = spark.createDataFrame(rows, "order_id int, product_id string")
    (p,) = product_affinity(items).collect()
    assert (p.a, p.b, p.n_pair, p.support, p.confidence, p.lift) == ("a", "b", 3, 0.6, 0.75, 1.25)
    rules = {(r.antecedent, r.consequent): r for r in association_rules(items, min_lift=0.0).collect()}
    assert rules["b", "a"].confidence == 1.0 and rules["a", "b"].lift == rules["b", "a"].lift and len(rules) == 4
    assert product_affinity(items.limit(0)).count() == 0


def test_wide_baskets_give_the_same_pairs(spark):
    rows = [(o, (o * 7 + k * k) % 23) for o in range(60) for k in range(o % 9)] + [(None, 1), (3, None)]
    items = spark.createDataFrame(rows, "order_id int, product_id int")
    pairs = [{(r.a, r.b): r.n_pair for r in pair_counts(items, "order_id", "product_id", 2, wide)[0].collect()} for wide in (500, 3, 1)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 50


def test_staged_text_with_line_feeds(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,"two\nlines",2024-02-03 04:05:06\n2,null,NULL\n')
    schema = "a int, b string, c timestamp"
    assert [(r.a, r.b) for r in files.read_stage_csv(spark, path, schema, multi_line=True).orderBy("a").collect()] == [(1, "two\nlines"), (2, None)]
    assert files.read_stage_csv(spark, path, schema, multi_line=True).filter("c = '2024-02-03 04:05:06'").count() == 1


@pytest.fixture(scope="module")
def shop(spark):
    inter = spark.range(600).select((F.col("id") * 31 % 23).alias("customer_id"), (F.col("id") * 17 % 29 + F.col("id") % 3).alias("product_id"), (1 + F.col("id") % 5).alias("quantity"), F.lit(3.0).alias("rating"), (F.col("id") % 7 + 0.5).alias("score"), F.lit("2024-01-01").cast("date").alias("last_date"))
    inter = inter.groupBy("customer_id", "product_id").agg(F.first("quantity").alias("quantity"), F.first("rating").alias("rating"), F.sum("score").alias("score"), F.max("last_date").alias("last_date"))
    # A few customers with few products, so that every list leaves room.
    inter = inter.filter((F.col("customer_id") % 5 != 0) | (F.col("product_id") < 6)).persist()
    products = spark.range(40).select(F.col("id").alias("product_id"), F.concat(F.lit("Thing kind"), (F.col("id") % 4).cast("string")).alias("product_name"), F.lit("cat").alias("category_name"), F.lit("brand").alias("brand"))
    return inter, products


def test_candidate_union_equals_brute_force(spark, shop):
    inter, products = shop
    part = lambda k: inter.select("customer_id", ((F.col("product_id") + k) % 40).alias("product_id"), (F.col("score") - 4 * (k == 1)).alias("score")).groupBy("customer_id", "product_id").agg(F.max("score").alias("score"))
    cf, content, rules, pop = part(1), part(2), part(3), hybrid.popularity(inter, products)
    got = {(r.customer_id, r.product_id): (r.score, r["rank"]) for r in hybrid.hybrid_recs(cf, content, rules, pop, inter, products).collect()}
    table = lambda df: {(r.customer_id, r.product_id): r.score for r in df.collect()}
    lists, pops, bought = [table(x) for x in (cf, content, rules)], {r.product_id: r.popularity for r in pop.collect()}, {(r.customer_id, r.product_id) for r in inter.collect()}
    want = {}
    for c in {c for c, _ in bought}:
        best = [max((s for (k, _), s in t.items() if k == c), default=0) for t in lists]
        rows = []
        for p in range(40):
            if (c, p) not in bought:
                parts = [t.get((c, p), 0) / b if b > 0 else 0 for t, b in zip(lists, best)]
                rows.append((-round(0.5 * parts[0] + 0.3 * parts[1] + 0.15 * parts[2] + 0.05 * pops[p], 6), p))
        want |= {(c, p): (-s, k + 1) for k, (s, p) in enumerate(sorted(rows)[:10])}
    assert len(got) == len(want)
    ranked = lambda t: {(c, rank): s for (c, _), (s, rank) in t.items()}
    a, b = ranked(got), ranked(want)  # ties in the sixth digit may name another product
    assert set(a) == set(b) and all(math.isclose(a[k], b[k], abs_tol=2e-6) for k in b) and len(set(got) & set(want)) > 0.97 * len(want)


def test_factors(spark, shop):
    inter, _ = shop
    f = factors.train_cf(inter, rank=5, iterations=5)
    mean = inter.select(F.stddev_pop(F.least("score", F.lit(5.0)))).first()[0]
    assert factors.cf_rmse(f, inter).first()[0] < mean
    fast, slow = (factors.cf_top_n(f, inter, 5, m) for m in (10**6, 7))
    key = lambda df: {(r.customer_id, r.product_id): round(r.score, 3) for r in df.collect()}
    a, b = key(fast), key(slow)
    assert a == b and not set(a) & {(r.customer_id, r.product_id) for r in inter.collect()}


def test_similar_products_share_signatures(spark, shop):
    _, products = shop
    vectors = hybrid.tfidf(hybrid.product_tokens(products), products)
    assert all(math.isclose(r[0], 1.0) for r in vectors.groupBy("product_id").agg(F.sum(F.col("weight") ** 2)).select(F.col("sum(POWER(weight, 2))")).collect())
    near = hybrid.similar_products(vectors, 3).filter("product_id = 8").orderBy("other_id").collect()
    assert [r.other_id for r in near] == [0, 4, 12] and near[0].similarity == pytest.approx(1.0)


def test_blocked_lists_equal_brute_force(spark, shop):
    inter, products = shop
    vectors = hybrid.tfidf(hybrid.product_tokens(products), products)
    table: dict = {}
    for r in vectors.collect():
        table.setdefault(r.product_id, {})[r.token] = r.weight
    bought: dict = {}
    for r in inter.collect():
        bought.setdefault(r.customer_id, []).append((r.last_date, r.product_id))
    want = {}
    for c, rows in bought.items():
        last = [p for _, p in sorted(rows, key=lambda x: (x[0], x[1]), reverse=True)[:10] if p in table]
        mean: dict = {}
        for p in last:
            for t, w in table[p].items():
                mean[t] = mean.get(t, 0) + w / len(last)
        scored = sorted((-round(sum(mean.get(t, 0) * w for t, w in v.items()), 6), p) for p, v in table.items() if p not in {x for _, x in rows})
        want |= {(c, p): -s for s, p in [x for x in scored if x[0] < 0][:7]}
    for block in (10**6, 9):
        got = {(r.customer_id, r.product_id): r.score for r in hybrid.content_recs(inter, vectors, n=7, block_items=block).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    near = {(r.product_id, r.other_id): r.similarity for r in hybrid.similar_products(vectors, 3, 9).collect()}
    for p, v in table.items():
        scored = sorted((-round(sum(v.get(t, 0) * w for t, w in o.items()), 6), q) for q, o in table.items() if q != p)[:3]
        assert {q for x, q in near if x == p} == {q for _, q in scored}
    assert hybrid.content_recs(inter, vectors.limit(0)).count() == 0 and hybrid.similar_products(vectors.limit(0)).count() == 0


def test_marts_are_written(spark, shop, tmp_path):
    from shoplake.recs.run import write_recommendations

    picks = spark.createDataFrame([(1, 2, "n, x", 0.5)], "customer_id long, product_id long, product_name string, score double")
    rules = spark.createDataFrame([(1, 2, 0.1, 0.2, 3.0)], "antecedent long, consequent long, support double, confidence double, lift double")
    write_recommendations(picks, rules, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/recommendations")).count() == 1
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "m/recommendations_csv")).first()["product_name"] == "n, x"
    assert spark.read.option("header", True).csv(str(tmp_path / "m/association_rules_csv")).first()["lift"] == "3.0"


@pytest.mark.parametrize("chunk", [3, 64])
def test_lists_by_length_bounds_are_exact_and_stop_early(chunk):
    """Equal scores, bought items, users of length nought; the longest vectors come first and most others are never scored."""
    import numpy as np

    from shoplake.recs.factors import scan

    rng = np.random.default_rng(chunk)
    items = rng.integers(-3, 4, (400, 4)).astype(np.float32) * np.repeat(np.array([64, 16, 4, 1], dtype=np.float32), 100)[:, None]
    users = np.r_[rng.integers(-3, 4, (50, 4)), np.zeros((2, 4))].astype(np.float32)
    order = np.lexsort((np.arange(400), -np.linalg.norm(items, axis=1)))
    have = [rng.choice(400, rng.integers(0, 30), replace=False).tolist() + [9999] for _ in users]
    row, item, value, scored = scan(users, have, np.arange(400)[order], items[order], 5, chunk)
    got = {u: [] for u in range(len(users))}
    for r, i, v in zip(row.tolist(), item.tolist(), value.tolist()):
        got[r].append((-v, i))
    for u in range(len(users)):
        want = sorted((-float(users[u] @ items[i]), i) for i in range(400) if i not in have[u])[:5]
        assert got[u] == want
    assert scored < (0.5 if chunk < 10 else 0.8) * len(users) * 400


@pytest.mark.parametrize("text_ids", [False, True])
def test_blocks_of_factors_change_no_list(spark, text_ids):
    from shoplake.recs.factors import top_by_factors

    vector = lambda i, k: [float((i * a) % b - b // 2) for a, b in ((3, 7), (5, 11), (1, 3))] if i % k else [0.0, 0.0, 0.0]
    kind = "string" if text_ids else "long"
    name = lambda i: f"p{i:03}" if text_ids else i
    users = spark.createDataFrame([(i, vector(i, 9)) for i in range(30)], "customer_id long, features array<float>")
    items = spark.createDataFrame([(name(i), [x * (1 + i % 5) for x in vector(i, 13)]) for i in range(120)], f"product_id {kind}, features array<float>")
    inter = spark.createDataFrame([(u, name((u * 7 + k) % 120)) for u in range(29) for k in range(u % 6 + 1)], f"customer_id long, product_id {kind}")
    lists = [sorted(tuple(r) for r in top_by_factors(users, items, inter, 8, block).collect()) for block in (1_000, 50, 7)]
    assert lists[0] == lists[1] == lists[2] and len(lists[0]) == 29 * 8


def test_lists_by_cells_leave_far_items_out():
    """Vectors of one length in six directions: a user's items are in one of them, the others are not scored."""
    import numpy as np

    from shoplake.recs.factors import scan

    rng = np.random.default_rng(5)
    far = np.eye(8)[:6]
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    items, users = unit(far[np.arange(3000) % 6] + 0.05 * rng.normal(size=(3000, 8))), unit(far[np.arange(60) % 6] + 0.05 * rng.normal(size=(60, 8)))
    have = [rng.choice(3000, 40, replace=False).tolist() for _ in users]
    row, item, value, scored = scan(users, have, np.arange(3000), items, 20, 256)
    for u in range(60):
        want = sorted(set(range(3000)) - set(have[u]), key=lambda i: -float(users[u] @ items[i]))[:20]
        assert set(item[row == u].tolist()) == set(want)
    assert scored < 0.3 * 60 * 3000


def test_of_items_with_one_vector_only_those_that_can_be_listed_are_scored(spark, monkeypatch):
    from shoplake.recs import factors

    users = spark.createDataFrame([(c, [float(c - 2), 1.0]) for c in range(5)], "customer_id long, features array<float>")
    items = spark.createDataFrame([(p, [float(p % 3 - 1), 1.0]) for p in range(600)], "product_id long, features array<float>")
    inter = spark.createDataFrame([(c, p) for c in range(5) for p in range(c, 30, 3)], "customer_id long, product_id long")
    seen = []
    monkeypatch.setattr(factors, "cells", lambda ids, matrix, f=factors.cells: (seen.append(len(ids)), f(ids, matrix))[1])
    got = {}
    for r in factors.top_by_factors(users, items, inter, 4).collect():
        got.setdefault(r.customer_id, set()).add((r.product_id, r.score))
    for c in range(5):
        all_ = sorted((-((c - 2) * (p % 3 - 1) + 1.0), p) for p in set(range(600)) - set(range(c, 30, 3)))
        assert got[c] == {(p, -s) for s, p in all_[:4]}
    assert seen == [3 * (4 + 10)]


def test_equal_vectors_are_scored_in_one_block(spark, monkeypatch):
    """Each once for a query, however many items share them and however many blocks there are."""
    from shoplake.recs import blocks

    vectors = spark.createDataFrame([(p, f"t{p % 4}", 1.0) for p in range(400)], "product_id long, token string, weight double")
    asked = spark.createDataFrame([(c, ["t0", "t1"], [0.9, 0.1 * c], [0, 4]) for c in range(1, 4)], "customer_id long, tokens array<string>, weights array<double>, have array<long>")
    seen = []
    monkeypatch.setattr(blocks, "in_blocks", lambda *a, f=blocks.in_blocks: ((seen.append(rows), rows)[1] for rows in f(*a)))
    got = {}
    for r in blocks.nearest(asked, "customer_id", vectors, "product_id", 6, block_items=2).collect():
        got.setdefault(r.customer_id, set()).add(r.product_id)
    assert got == {c: {8, 12, 16, 20, 24, 28} for c in range(1, 4)}
    assert len(seen) > 1 and sum(map(len, seen)) == 4 and sum(rows["members"].map(len).sum() for rows in seen) == 4 * (6 + 2)
