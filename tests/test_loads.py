"""Jobs over several runs: keys, merges, loads and what they leave alone."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from shoplake.functions import expr as E
from shoplake.jobs import clean, warehouse
from shoplake.operators import basket, scd
from shoplake.sources import ledger

DIM = "customer_id long, city string, segment string, start_date date, end_date date, is_current boolean"


def test_composite_keys_stay(spark):
    load = lambda *rows: spark.createDataFrame(rows, "country string, city string")
    first = warehouse.build_dim(load(("DE", "Berlin"), ("FR", "Paris"), ("FR", None), (None, "Nowhere"), ("DE", "Berlin")), ["country", "city"], "geo_sk")
    old = {(r.country, r.city): r.geo_sk for r in first.collect()}
    assert sorted(old.values()) == [1, 2, 3] and set(old) == {("DE", "Berlin"), ("FR", "Paris"), ("FR", None)}
    new = {(r.country, r.city): r.geo_sk for r in warehouse.build_dim(load(("AT", "Wien"), ("DE", "Berlin"), ("AT", "Graz")), ["country", "city"], "geo_sk", first).collect()}
    assert {k: new[k] for k in old} == old and sorted(new[k] for k in new.keys() - old.keys()) == [4, 5]
    one = warehouse.build_dim(spark.createDataFrame([("b",), ("c",)], "channel string"), ["channel"], "sk", spark.createDataFrame([("a", 7)], "channel string, sk long"))
    assert {r.channel: r.sk for r in one.collect()} == {"a": 7, "b": 8, "c": 9}


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_closed_slices_are_left_alone(spark, tmp_path):
    d, path = dt.date, str(tmp_path / "dim")
    rows = [(1, "a", "s", d(2020, 1, 1), None, True), (2, "a", "s", d(2020, 1, 1), None, True), (3, "y", "s", d(2020, 1, 1), None, True), (3, "z", "s", d(2019, 1, 1), d(2020, 1, 1), False)]
    whole = dim = spark.createDataFrame(rows, DIM)
    scd.store_slices(dim, path)
    old = {f for f in files(path) if "is_current=false" in f}
    shown = lambda df: sorted(map(str, df.select("customer_id", "city", "segment", "start_date", "end_date", "is_current").collect()))
    for day, rows in (("2021-06-01", [(1, "b", "s"), (4, "n", "s")]), ("2021-06-01", [(1, "b", "s"), (4, "n", "s")]), ("2021-07-01", [(1, "c", "s"), (4, "m", "s"), (3, None, "s")]), ("2021-07-01", [(3, "w", "s")])):
        source = spark.createDataFrame(rows, "customer_id long, city string, segment string")
        scd.scd2_merge_into(spark, path, source, "customer_id", ["city", "segment"], day)
        whole = scd.scd2_merge(whole, source, "customer_id", ["city", "segment"], day)
        now = {f for f in files(path) if "is_current=false" in f}
        assert old <= now and shown(scd.read_slices(spark, path)) == shown(whole)
        old = now
    plan = scd._slices(spark, path).filter("is_current")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_current" in plan


def test_history_is_read_for_the_days_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "history")
    history = spark.range(1000).select(F.col("id").alias("order_id"), (F.lit(20240101) + F.col("id") % 20).cast("int").alias("order_date_key"))
    history.write.partitionBy("order_date_key").parquet(path)
    batch = spark.createDataFrame([(3, 20240104), (4, 20240105), (5000, 20240104), (None, 20240104), (5001, 20250101)], "order_id long, order_date_key int")
    got = warehouse.unseen(batch, spark.read.parquet(path), "order_id", "order_date_key")
    assert sorted(r.order_id for r in got.collect()) == sorted(r.order_id for r in batch.filter("order_id is not null").join(history, "order_id", "left_anti").collect()) == [5000, 5001]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "order_date_key" in plan and "IN (20240104,20240105,20250101)" in plan.replace(", ", ",") or "INSET" in plan
    for small in (0, 10):
        assert warehouse.unseen(batch, history, "order_id", small=small).count() == 2


def test_ledger(spark, tmp_path):
    src, dst = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    load = lambda **k: {os.path.basename(r.file): (r.load, r.rows, r.errors, r.status) for r in ledger.load_files(spark, str(src), "a int, b string", dst, **k).collect()}
    (src / "1.csv").write_text("a,b\n1,x\nbad,y\n")
    (src / "2.csv").write_text("a,b\nworse,y\n")
    (src / "3.csv").write_text("a,b\n")
    assert load() == {"1.csv": (0, 1, 1, "PARTIALLY_LOADED"), "2.csv": (0, 0, 1, "LOAD_FAILED"), "3.csv": (0, 0, 0, "EMPTY")}
    assert load() == {}
    (src / "2.csv").write_text("a,b\n7,NULL\n8,z\n")  # mended: another size
    assert load() == {"2.csv": (1, 2, 0, "LOADED")}
    rows = lambda: sorted((r.a, r.b) for r in ledger.loaded_rows(spark, dst).collect())
    assert rows() == [(1, "x"), (7, None), (8, "z")] and ledger.loaded_rows(spark, dst, "bad").count() == 1
    assert set(load(force=True)) == {"1.csv", "2.csv", "3.csv"}
    assert rows() == [(1, "x"), (7, None), (8, "z")] and ledger.read_ledger(spark, dst).count() == 7


def test_report_is_observed_in_the_pass_that_writes(spark, tmp_path):
    from shoplake import queries_jobs
    from shoplake.sources.fixtures import model

    raw = queries_jobs.raw_tables(*[model(spark, "/root/testdata/sf0.001", t) for t in queries_jobs.RAW])
    rows, report = clean.run_etl(raw, "2001-12-31", str(tmp_path / "clean"))
    plain, counted = clean.run_etl(raw, "2001-12-31")
    assert sorted(map(str, report.collect())) == sorted(map(str, counted.collect()))
    for name in plain:
        assert rows[name].count() == plain[name].count()
    assert sorted(map(str, rows["customers"].collect())) == sorted(map(str, plain["customers"].collect()))
    seen = clean.clean_customers(raw["customers"], "2001-12-31", clean.Observation("one"))[0]
    assert str(seen._jdf.queryExecution().executedPlan()).count("CollectMetrics") == 1
    with pytest.raises(ValueError):
        clean.run_etl({}, "2001-12-31")


def test_titles_are_those_of_python(spark):
    texts = ["o'brien", "mary-jane  watson", "ÉMILE zola", "iPhone 4s", "x2y", "don't", "", " padded\t", "漢abc", "école", "ǆ", "straße", "ΑΒΓ δ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.strip_title(F.col("t"))).collect()]
    assert got == [t.strip().title() for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(E.strip_title(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("bucket", [1, 30, 400])
def test_as_of_join_in_stretches(spark, bucket):
    d = dt.date
    versions = [(1, "a", d(2020, 1, 1), d(2020, 3, 1), False), (1, "b", d(2020, 3, 1), d(2020, 3, 1), False), (1, "c", d(2020, 3, 1), None, True), (2, "x", d(2020, 6, 1), None, True), (3, "gone", d(2010, 1, 1), d(2011, 1, 1), False)]
    dim = spark.createDataFrame(versions, "k int, city string, start_date date, end_date date, is_current boolean")
    fact = spark.createDataFrame([(k, d(2019, 12, 1) + dt.timedelta(days=i)) for k in (1, 2, 3, 4) for i in range(0, 250, 7)] + [(1, None), (None, d(2020, 1, 5))], "k int, day date")
    shown = lambda df: sorted(map(str, df.select("k", "day", "city").collect()))
    for how in ("left", "inner"):
        assert shown(scd.as_of_join(fact, dim, "k", "day", how, bucket_days=bucket)) == shown(scd.as_of_join(fact, dim, "k", "day", how))
    assert scd.as_of_join(fact.limit(0), dim, "k", "day", bucket_days=bucket).count() == 0


def test_pairs_below_the_support_are_never_made(spark):
    from shoplake.sources.fixtures import model

    items = model(spark, "/root/testdata/sf0.01", "m_items")
    rules = lambda s: sorted(map(str, basket.association_rules(items, min_support=s).collect()))
    for support in (0.0001, 0.0002):
        every = basket.association_rules(items, min_support=0.0).filter(F.col("support") >= support)
        assert rules(support) == sorted(map(str, every.collect()))
    made = [basket.pair_counts(items, "order_id", "product_id", min_support=s)[0].agg(F.sum("n_pair")).first()[0] or 0 for s in (0.0, 0.003)]
    assert made[0] > 100_000 and made[1] < made[0] / 100
