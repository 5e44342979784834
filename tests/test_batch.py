import datetime as dt

from pyspark.sql import functions as F

from shoplake.jobs import batch, warehouse


def test_files_to_marts(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    orders = ["order_id,customer_id,order_date,status,shipping_method,shipping_cost,discount_amount,tax_amount,total_amount,currency,channel"]
    items = ["order_item_id,order_id,product_id,quantity,unit_price,discount_pct,line_total"]
    for i in range(40):
        orders.append(f"o{i},c{i % 7},2024-0{1 + i % 6}-1{i % 9} 10:00:00,{'COMPLETED' if i % 5 else 'CANCELLED'},air,1,2,3,{100 + i},usd,web")
        items += [f"x{i},o{i},p1,1,10,0,10", f"y{i},o{i},p{2 + i % 3},2,5,0,10", f"z{i},o{i},p{i + 10},2,5,0,10"]
    (src / "orders.csv").write_text("\n".join(orders) + "\n")
    (src / "order_items.csv").write_text("\n".join(items) + "\n")
    counts = batch.from_files(spark, str(src), str(tmp_path / "out"), "2024-12-31")
    assert counts["segments"].agg(F.sum("rows")).first()[0] == 7 == counts["tiers"].agg(F.sum("rows")).first()[0]
    assert counts["pairs"].first()[0] == 0  # p1 is in every order: lift is exactly 1
    kpis = spark.read.parquet(str(tmp_path / "out/marts/daily_kpis"))
    assert kpis.agg(F.sum("orders")).first()[0] == 40
    report = spark.read.json(str(tmp_path / "out/dq_report")).first()
    assert report.total_rows == report.valid_rows == 40


def test_dimensions(spark):
    stage = spark.createDataFrame([(1, " Ann", "Lee ", "a@x.io", "Oslo", "NO", "s", dt.date(1990, 1, 1), dt.datetime(2024, 1, 2, 1)), (2, "Bo", None, "b@x.io", "Rome", "IT", "s", None, dt.datetime(2023, 12, 1))], "customer_id long, first_name string, last_name string, email string, city string, country string, segment string, date_of_birth date, _load_timestamp timestamp")
    empty = spark.createDataFrame([], "customer_id long, full_name string, email string, city string, country string, segment string, age_group string, start_date date, end_date date, is_current boolean")
    (r,) = warehouse.scd2_customer(empty, stage, "2024-01-02", "2024-01-02 02:00:00").collect()
    assert (r.customer_id, r.full_name, r.age_group, r.is_current) == (1, "Ann Lee", "25-34", True)
    both = {r.customer_id: r.age_group for r in warehouse.scd2_customer(empty, stage, "2024-01-02").collect()}
    assert both == {1: "25-34", 2: "55+"}
    products = spark.createDataFrame([("p", "n", "toys", "b", 10.0, 4.0, True), ("q", "n", "none", "b", 0.0, 4.0, False)], "product_id string, product_name string, category_name string, brand string, unit_price double, cost_price double, is_active boolean")
    categories = warehouse.build_dim(products.filter("category_name = 'toys'"), ["category_name"], "category_sk")
    none = spark.createDataFrame([], "product_id string, product_name string, category_sk long, brand string, unit_price double, cost_price double, margin_pct double, is_active boolean, start_date date, end_date date, is_current boolean")
    got = {r.product_id: (r.category_sk, r.margin_pct) for r in warehouse.scd2_product(none, products, categories, "2024-01-02").collect()}
    assert got == {"p": (1, 60.0), "q": (None, None)}
    geo = warehouse.build_dim(stage, ["country", "city"], "geo_sk")
    assert sorted(r.geo_sk for r in geo.collect()) == [1, 2]


def test_lifetime_value_rounds_doubles_as_its_sql(spark):
    """Values near a half: 77915.555 is less than its decimal."""
    from shoplake.jobs import analytics

    rows = [(1, "SHIPPED", dt.date(1995, 8, 27), "2085.20"), (1, "SHIPPED", dt.date(2000, 11, 3), "153745.91")]
    orders = spark.createDataFrame(rows, "customer_id long, status string, order_date date, net string").select("*", F.col("net").cast("decimal(13,2)").alias("net_revenue"))
    (r,) = analytics.clv_batch(orders).collect()
    assert (r.aov, r.monthly_frequency, r.clv_365d) == (77915.55, 0.0316, 19204.63)


def test_predicted_value_of_segments_rounds_as_its_sql(spark):
    """3 orders in 1,600 days are 0.05625 a month, a double just below it whose ten thousandfold is a half."""
    from shoplake.jobs import analytics

    rows = [(1, "COMPLETED", dt.date(1996, 10, 8), "201619.85"), (1, "COMPLETED", dt.date(1998, 2, 20), "266079.19"), (1, "COMPLETED", dt.date(2001, 2, 23), "224271.78")]
    orders = spark.createDataFrame(rows, "customer_id long, status string, order_date date, net string").select("*", F.col("net").cast("decimal(13,2)").alias("net_revenue"))
    customers = spark.createDataFrame([(1, "Ann", "Oslo", "NO", "s")], "customer_id long, full_name string, city string, country string, segment string")
    (r,) = warehouse.agg_customer_rfm(analytics.rfm_quantile(orders, "2001-12-31", rel_err=0), analytics.clv_batch(orders), customers).collect()
    assert r.predicted_clv == 101290.69
