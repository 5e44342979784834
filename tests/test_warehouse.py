import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shoplake.jobs import analytics as A
from shoplake.jobs import warehouse
from shoplake.operators import governance as G
from shoplake.operators import scd
from shoplake.operators.ranking import global_row_number, ntile_scaled

DIM = "customer_id long, city string, segment string, start_date date, end_date date, is_current boolean"


def test_scd2_cases(spark):
    d = dt.date
    dim = spark.createDataFrame([(1, "a", "s", d(2020, 1, 1), None, True), (2, "a", "s", d(2020, 1, 1), None, True), (3, "a", None, d(2020, 1, 1), None, True), (4, "a", "s", d(2020, 1, 1), None, True), (5, "z", "s", d(2019, 1, 1), d(2020, 1, 1), False), (5, "y", "s", d(2020, 1, 1), None, True)], DIM)
    src = spark.createDataFrame([(1, "a", "s", 1), (2, "b", "s", 1), (3, "a", "s", 1), (4, "a", None, 1), (6, "n", "s", 1), (6, "newest", "s", 2), (None, "x", "x", 1)], "customer_id long, city string, segment string, loaded int")
    src = scd.dedupe_keep_first(src, ["customer_id"], [F.desc("loaded")]).drop("loaded")
    pick = lambda day, df: scd.scd2_merge(df, src, "customer_id", ["city", "segment"], day)
    out = pick("2021-06-01", dim)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.customer_id, []).append((r.city, r.segment, r.end_date, r.is_current))
    assert rows[1] == [("a", "s", None, True)] and len(rows[2]) == len(rows[3]) == len(rows[4]) == len(rows[5]) == 2
    assert rows[6] == [("newest", "s", None, True)] and None not in rows
    again = pick("2021-06-01", out)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert out.filter("is_current").groupBy("customer_id").count().filter("count > 1").count() == 0 and scd.intervals_overlap(out, "customer_id").count() == 0
    assert {r.customer_id: r.city for r in scd.as_of(out, "2019-06-01").collect()} == {5: "z"}


def test_surrogate_keys_stay(spark):
    old = spark.createDataFrame([("a", 1), ("c", 2)], "k string, sk long")
    got = {r.k: r.sk for r in scd.surrogate_keys(spark.createDataFrame([("a",), ("b",), ("d",), ("b",)], "k string"), "k", old).collect()}
    assert got["a"] == 1 and sorted([got["b"], got["d"]]) == [3, 4]


def test_global_row_number_and_ntile_equal_windows(spark):
    from pyspark.sql import Window

    df = spark.range(1003).select("id", (F.col("id") * 7919 % 50).alias("v"))
    order = [F.col("v"), F.col("id")]
    want = {r.id: (r.n, r.t) for r in df.withColumns({"n": F.row_number().over(Window.orderBy(*order)), "t": F.ntile(5).over(Window.orderBy(*order))}).collect()}
    assert {r.id: r.n for r in global_row_number(df, order, "n", 7).collect()} == {k: n for k, (n, _) in want.items()}
    assert {r.id: r.t for r in ntile_scaled(df, 5, order, "t").collect()} == {k: t for k, (_, t) in want.items()}


def test_fact_load_is_incremental(spark):
    orders = spark.createDataFrame([(1, 1, "web", dt.date(2024, 1, 1), "COMPLETED", 10.0, 1.0, 0.5, 0.0), (None, 1, "web", dt.date(2024, 1, 1), "COMPLETED", 10.0, 1.0, 0.5, 0.0), (2, 99, "web", dt.date(2024, 1, 1), "COMPLETED", 1.0, 0.0, 0.0, 0.0)], "order_id long, customer_id long, channel string, order_date date, status string, total_amount double, discount_amount double, tax_amount double, shipping_cost double")
    items = spark.createDataFrame([(1, 5), (1, 6)], "order_id long, product_id long")
    dim = spark.createDataFrame([(1, 11, "US", "X", True), (1, 10, "US", "Y", False)], "customer_id long, customer_sk long, country string, city string, is_current boolean")
    geo = spark.createDataFrame([("US", "X", 7), ("US", "X", 8)], "country string, city string, geo_sk long")
    channels = spark.createDataFrame([("web", 3)], "channel string, channel_sk long")
    none = spark.createDataFrame([], "order_id long")
    first = warehouse.load_fact_orders(orders.unionByName(orders), items, dim, channels, geo, none)
    (r,) = first.collect()
    assert (r.order_id, r.item_count, r.geo_sk, r.customer_sk, r.net_revenue) == (1, 2, 7, 11, 9.0)
    assert warehouse.load_fact_orders(orders, items, dim, channels, geo, first).count() == 0


def test_masking(spark):
    df = spark.createDataFrame([("ann@x.io", "1234567", "Ann"), ("noat", "12", None), (None, None, "B")], "email string, phone string, first_name string")
    seen = {role: G.apply_masking(df, role).collect() for role in (G.ENGINEER, G.ANALYST, G.BI)}
    assert seen[G.ENGINEER][0].email == "ann@x.io" and seen[G.ANALYST][0].email == "***@x.io" and seen[G.ANALYST][1].email == "***" and seen[G.BI][0].email == G.REDACTED
    assert seen[G.ANALYST][0].phone == "123****67" and seen[G.ANALYST][0].first_name == "Ann" and seen[G.BI][0].first_name == G.REDACTED and seen[G.BI][1].first_name is None
    rows = spark.createDataFrame([("US",), ("DE",)], "country string")
    assert G.row_access(rows, G.ADMIN).count() == 2 and G.row_access(rows, G.BI, "US").count() == 1 and G.row_access(rows, "X").count() == 0


def test_cohorts_and_growth_gaps(spark):
    rows = [(1, 1, dt.date(2024, 1, 5)), (2, 1, dt.date(2024, 3, 5)), (3, 2, dt.date(2024, 1, 9)), (4, 3, dt.date(2024, 3, 1))]
    orders = spark.createDataFrame([(o, c, d, "COMPLETED", 10.0) for o, c, d in rows], "order_id long, customer_id long, order_date date, status string, net_revenue double").withColumn("net_revenue", F.col("net_revenue").cast("decimal(13,2)"))
    got = {(r.cohort_month.month, r.period): r.retention_pct for r in A.cohort_retention(orders).collect()}
    assert got == {(1, 0): 100.0, (1, 2): 50.0, (3, 0): 100.0}
    assert {r.month: r.mom_pct for r in A.revenue_growth(orders).collect()} == {1: None, 3: 0.0}
    assert {r.month: r.mom_pct for r in A.revenue_growth(orders, calendar=True).collect()} == {1: None, 3: None}


#: Shuffles that a query's first plan may hold, those that are reused when it runs counted each time, and columns that its scans may read of the widest table.
PLANS = {
    "a1_rfm_quantile": (5, {"l_orderkey", "l_extendedprice", "l_discount"}),
    "a5_cohort_retention": (6, set()),
    "a8_funnel_by_channel": (2, set()),
    "a10_product_affinity": (14, {"l_orderkey", "l_partkey"}),
    "w4_load_fact_orders": (14, {"l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_partkey"}),
    "x5_velocity_anomaly": (1, set()),
}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plans(spark, name):
    from shoplake.queries import QUERIES

    shuffles, columns = PLANS[name]
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange rangepartitioning") <= shuffles
    read = {c for part in plan.split("ReadSchema: struct<")[1:] for c in re.findall(r"\b(l_[a-z]+):", part.split("\n")[0])}
    assert read <= columns


def test_filters_reach_the_scan(spark):
    from shoplake.queries import QUERIES

    plan = QUERIES["x2_trending_products"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan or "PushedFilters: [Is" in plan
    plan = QUERIES["a3_clv_sql"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "o_comment" not in plan


@pytest.mark.parametrize("days,last", [(1825, dt.date(2024, 12, 29))])
def test_date_dim_range(spark, days, last):
    dim = warehouse.date_dim(spark, days=days)
    assert dim.count() == days and dim.agg(F.max("full_date")).first()[0] == last


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_keys_at_places_equal_a_sort(spark, few):
    """Ties in whole, negative values, far bounds, places at both ends; few cells, so that the search goes on by value and by tie."""
    import random

    from shoplake.operators.ranking import keys_at, tile_ends

    rng = random.Random(few)
    rows = [(i * 37 % 1009, rng.randrange(-5, 5), rng.choice([-(10**12), 3, 3, 3, 10**12 + i])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(3)
    for n in (500, 3, 1):
        part, places = df.filter(F.col("id").isin([r[0] for r in rows[:n]])), [0, 1, *tile_ends(n, 5), n]
        got = keys_at(part, {"a": (F.col("a"), places), "b": (-F.col("b"), places)}, "id", cells=16, few=few)
        for name, key in (("a", lambda r: (r[1], r[0])), ("b", lambda r: (-r[2], r[0]))):
            want = sorted(map(key, rows[:n]))
            assert got[name] == [want[p - 1] if p else None for p in places]


@pytest.mark.parametrize("orientation", ["best_high", "literal"])
def test_tiles_by_boundaries_equal_tiles_by_ranks(spark, orientation):
    from shoplake.sources.fixtures import model

    orders = model(spark, "/root/testdata/sf0.001", "m_orders")
    shown = lambda df: sorted(map(str, df.select("customer_id", "rfm_code", "segment").collect()))
    by_ranks = A.rfm_ntile(orders.withColumn("customer_id", F.format_string("%09d", "customer_id")), "2001-12-31", orientation)
    assert shown(A.rfm_ntile(orders, "2001-12-31", orientation)) == shown(by_ranks.withColumn("customer_id", F.col("customer_id").cast("long")))
    assert A.rfm_ntile(orders.limit(0), "2001-12-31", orientation).count() == 0
    plan = A.rfm_ntile(orders, "2001-12-31", orientation)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Window" not in plan
