from pyspark.sql import functions as F

from shoplake.functions import expr as E
from shoplake.jobs import clean
from shoplake.operators.quality import dq_totals


def issues(report):
    return {i.rule: i["count"] for i in report.first().issues}


def test_customers(spark):
    cols = "customer_id string, email string, first_name string, last_name string, date_of_birth string, gender string, country string, segment string, registration_date string, _row_number long"
    rows = [
        ("1", "A@x.io", "ann", "o'brien", "1980-05-05", " F ", " us", None, "2020-01-01", 1), ("1", "b@x.io", "dup", "x", "1980-05-05", "f", "us", "s", "2020-01-01", 2),
        ("2", None, "n", "n", None, "f", "us", "s", "2020-01-01", 3), ("3", " pad@x.io", "n", "n", None, "f", "us", "s", "2020-01-01", 4), ("4", "c@x.io", "n", "n", None, "f", "us", "s", "2999-01-01", 5),
        ("5", "d@x.io", "\tpat\t", "n", None, "f", "us", "s", "not a date", 6), ("6", "e@x.io", "kid", "n", "2019-01-01", "f", "us", "s", "2020-01-01", 7),
    ]
    good, report = clean.clean_customers(spark.createDataFrame(rows, cols), "2024-06-30")
    got = {r.customer_id: r for r in good.collect()}
    assert set(got) == {"1", "5"}
    assert got["1"].email == "a@x.io" and got["1"].last_name == "O'Brien" and got["1"].gender == "f" and got["1"].country == "US" and got["1"].segment == "Unknown" and got["1"].age == 44 and got["1"].age_group == "35-44"
    assert got["5"].first_name == "Pat" and got["5"].registration_date is None and got["5"].age is None and got["5"].age_group is None
    assert issues(report) == {"duplicate_customer_id": 1, "null_email": 1, "invalid_email_format": 1, "future_registration_date": 1, "dob_too_young": 1}
    assert dq_totals(report).first()["rows_out"] == 2


def test_products_orders_payments_reviews_clicks(spark):
    p = spark.createDataFrame([("1", " tv", "c", "acme co", "10", "4", "True"), ("2", "x", "c", "b", "0", "1", "1"), ("3", "x", "c", "b", "10", "-2", "yes"), ("4", "x", "c", "b", "10", "12", None), ("5", "x", "c", "b", None, None, "no")], "product_id string, product_name string, category_name string, brand string, unit_price string, cost_price string, is_active string")
    good, report = clean.clean_products(p, strict_report=True)
    got = {r.product_id: r for r in good.collect()}
    assert set(got) == {"1", "3", "4", "5"} and got["3"].cost_price == 5.0 and got["4"].gross_margin_pct == -20.0 and got["1"].is_active and not got["4"].is_active and got["1"].brand == "Acme Co"
    assert issues(report) == {"non_positive_unit_price": 1, "negative_cost_price": 1, "inverted_margin": 1}
    o = spark.createDataFrame([("1", "9", "2024-01-01 10:00:00", "COMPLETED", "5", "10", "1", "100", "usd", None), ("2", "9", "bad", "lost", "x", None, None, "-5", None, "web"), ("3", "9", None, None, None, None, None, "oops", None, "web")], "order_id string, customer_id string, order_date string, status string, shipping_cost string, discount_amount string, tax_amount string, total_amount string, currency string, channel string")
    i = spark.createDataFrame([("1", None, "10", "10", "9"), ("1", "2", "10", "0", "7")], "order_id string, quantity string, unit_price string, discount_pct string, line_total string")
    orders, items, report = clean.clean_orders(o, i)
    got = {r.order_id: r for r in orders.collect()}
    assert set(got) == {"1", "3"} and got["1"].net_revenue == 85.0 and got["1"].channel == "web" and got["1"].currency == "USD" and got["3"].status == "PENDING"
    assert issues(report) == {"negative_total_amount": 1, "invalid_status": 1}
    assert clean.line_total_mismatch(items).first()[0] == 1
    pay = spark.createDataFrame([("1", "1", "2024-01-01", " PayPal ", "5"), ("2", "1", "x", "shells", "5"), ("3", "1", "x", None, None)], "payment_id string, order_id string, payment_date string, payment_method string, amount string")
    good, report = clean.clean_payments(pay)
    assert {r.payment_id: r.payment_method for r in good.collect()} == {"1": "paypal", "2": "other"} and issues(report) == {"null_amount": 1}
    rev = spark.createDataFrame([(str(k), "p", f"c{k}", r, "t", " " + "b" * 4001, "2024-01-01", None, "1") for k, r in enumerate(["0", "1", "5", "6", None, "4.5", "x"])], "review_id string, product_id string, customer_id string, rating string, review_title string, review_body string, review_date string, helpful_votes string, verified_purchase string")
    good, report = clean.clean_reviews(rev)
    got = {r.review_id: r for r in good.collect()}
    assert set(got) == {"1", "2", "5"} and got["1"].sentiment == -1.0 and len(got["1"].review_body) == 4000 and issues(report) == {"invalid_rating": 4}
    ev = spark.createDataFrame([("1", " Purchase ", "", "2024-01-01 00:00:00", "Mobile"), ("1", "x", "", "2024-01-01 00:00:00", "m"), ("2", "hover", "c", "bad", "m")], "event_id string, event_type string, customer_id string, event_timestamp string, device_type string")
    good, report = clean.clean_clickstream(ev)
    (r,) = good.collect()
    assert r.event_type == "purchase" and r.customer_id is None and issues(report) == {"null_timestamp": 1}
    tables, report = clean.run_etl({"orders": o, "order_items": i, "payments": pay, "reviews": rev}, "2024-06-30")
    assert set(tables) == {"orders", "order_items", "payments", "reviews"} and report.count() == 3


def test_age_bands(spark):
    df = spark.createDataFrame([(a,) for a in (0, 1, 24, 25, 34, 35, 150, 151, None)], "a int")
    assert [r[0] for r in df.select(E.age_group(F.col("a"))).collect()] == [None, "18-24", "18-24", "25-34", "25-34", "35-44", "55+", None, None]
