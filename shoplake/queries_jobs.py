"""Registered queries over whole jobs: filters, ETL with its report, dimensions, files written and read back, streams, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.functions import expr as E
from shoplake.functions.store import new_path, written
from shoplake.jobs import analytics as A
from shoplake.jobs import batch, clean, warehouse
from shoplake.operators import basket, governance, quality
from shoplake.queries import AS_OF, DIRTY_CUSTOMERS, DIRTY_PRODUCTS, INTER, ORACLE_SQL, RECS, TFIDF, dirty_customers, dirty_events, dirty_items, dirty_orders, dirty_products, query
from shoplake.recs import factors, hybrid
from shoplake.recs.run import write_recommendations
from shoplake.sources import events as event_sources
from shoplake.sources import files, schemas
from shoplake.streaming import jobs as stream
from shoplake.streaming import sinks

# ---- filters and expressions -----------------------------------------------


@query("q2_q7_q8_filters", ("m_customers",), DIRTY_CUSTOMERS + "SELECT customer_id, CAST(rn AS BIGINT) AS rn FROM f WHERE NOT n AND NOT w AND NOT y")
def _(customers):
    day = E.as_date(AS_OF)
    rows = dirty_customers(customers).withColumns({c: E.to_date_or_null(F.col(c)) for c in ("registration_date", "date_of_birth")})
    rows = quality.min_age(quality.not_in_future(quality.drop_nulls(rows, "email"), "registration_date", day), "date_of_birth", day)
    return rows.select("customer_id", F.col("_row_number").cast("long").alias("rn"))


@query("q11_q18_q25_filters", ("m_products",), "WITH " + DIRTY_PRODUCTS + "SELECT product_id, p AS unit_price, c AS cost_price FROM dp WHERE p > 0 AND c >= 0 AND p BETWEEN 950 AND 1500")
def _(products):
    rows = dirty_products(products).withColumns({c: F.col(c).try_cast("double") for c in ("unit_price", "cost_price")})
    return quality.in_range(quality.non_negative(quality.positive(rows, "unit_price"), "cost_price"), "unit_price", 950, 1500).select("product_id", "unit_price", "cost_price")


@query("q10_age_group_by_year", ("m_customers",), """WITH b AS (SELECT customer_id, CASE WHEN customer_id % 9 <> 0 THEN CAST(DATE '2001-12-31' - CAST(customer_id * 37 % 30000 AS INTEGER) AS DATE) END born FROM m_customers)
SELECT customer_id, CASE WHEN 2001 - year(born) < 25 THEN '18-24' WHEN 2001 - year(born) < 35 THEN '25-34' WHEN 2001 - year(born) < 45 THEN '35-44' WHEN 2001 - year(born) < 55 THEN '45-54' ELSE '55+' END AS age_group FROM b""")
def _(customers):
    i = F.col("customer_id")
    born = F.when(i % 9 != 0, F.date_sub(F.lit("2001-12-31").cast("date"), (i * 37 % 30000).cast("int")))
    return customers.select(i, E.age_group_by_year(born, AS_OF).alias("age_group"))


# ---- cleaning ----------------------------------------------------------------


def dirty_payments(payments: DataFrame) -> DataFrame:
    i = F.col("payment_id")
    method = F.element_at(F.array(F.lit(" Credit_Card"), F.lit("PAYPAL\t"), F.lit("cheque"), F.lit(None).cast("string"), F.lit("bank_transfer")), (i % 5 + 1).cast("int"))
    paid = F.when(i % 13 == 0, F.lit("soon")).otherwise(F.concat(F.lit("1998-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-05 06:07:08")))
    rows = payments.select(i.cast("string").alias("payment_id"), "order_id", paid.alias("payment_date"), method.alias("payment_method"), F.when(i % 9 == 0, F.lit("n/a")).otherwise(F.col("amount").cast("string")).alias("amount"), (i * 2).alias("_row_number"))
    again = rows.filter(i % 5 == 0).withColumns({"_row_number": F.col("_row_number") + 1, "amount": F.lit("1.5")})
    return again.unionByName(rows)


DIRTY_PAYMENTS = """y AS (SELECT payment_id, order_id, CASE WHEN payment_id % 13 <> 0 THEN CAST('1998-' || lpad(CAST(payment_id % 12 + 1 AS VARCHAR), 2, '0') || '-05 06:07:08' AS TIMESTAMP) END paid, list_value('credit_card', 'paypal', 'other', 'other', 'bank_transfer')[payment_id % 5 + 1] AS method, CASE WHEN payment_id % 9 <> 0 THEN CAST(amount AS DOUBLE) END amt FROM m_payments)
"""


@query("clean_payments", ("m_payments",), "WITH " + DIRTY_PAYMENTS + "SELECT CAST(payment_id AS VARCHAR) AS payment_id, order_id, paid AS payment_date, method AS payment_method, amt AS amount FROM y WHERE amt IS NOT NULL")
def _(payments):
    good, _ = clean.clean_payments(dirty_payments(payments))
    return good.drop("_row_number")


def dirty_reviews(reviews: DataFrame) -> DataFrame:
    i, c = F.col("product_id"), F.col("customer_id")
    rating = F.when(i % 11 == 0, F.lit("five")).when(i % 13 == 0, F.lit("9")).when(i % 17 == 0, F.lit(None)).otherwise(F.col("rating").cast("string"))
    body = F.concat(F.lit(" \t"), F.repeat(F.lit("good "), (c % 1000).cast("int")), F.lit(" "))
    return reviews.select(
        i, c, rating.alias("rating"), F.col("review_date").cast("string").alias("review_date"), F.when(c % 3 == 0, F.lit("none")).otherwise((c % 50).cast("string")).alias("helpful_votes"),
        F.element_at(F.array(F.lit("TRUE"), F.lit("Yes"), F.lit("1"), F.lit("no"), F.lit(None).cast("string")), (c % 5 + 1).cast("int")).alias("verified_purchase"), body.alias("review_body"), F.repeat(F.lit("t"), (c % 700).cast("int")).alias("review_title"), F.col("rating").alias("_row_number"),
    )


DIRTY_REVIEWS = """v0 AS (SELECT product_id, customer_id, review_date, min(rating) rt FROM m_reviews GROUP BY 1, 2, 3),
v1 AS (SELECT *, CASE WHEN product_id % 11 = 0 OR product_id % 13 = 0 OR product_id % 17 = 0 THEN NULL ELSE rt END r FROM v0)
"""


@query("clean_reviews", ("m_reviews",), "WITH " + DIRTY_REVIEWS + """SELECT product_id, customer_id, CAST(r AS INTEGER) AS rating, review_date, CAST(CASE WHEN customer_id % 3 = 0 THEN 0 ELSE customer_id % 50 END AS INTEGER) AS helpful_votes, customer_id % 5 < 3 AS verified_purchase,
 CAST(least(4000, greatest(customer_id % 1000 * 5 - 1, 0)) AS INTEGER) AS body_chars, CAST(least(500, customer_id % 700) AS INTEGER) AS title_chars, (r - 3) / 2::DOUBLE AS sentiment FROM v1 WHERE r IS NOT NULL""")
def _(reviews):
    good, _ = clean.clean_reviews(dirty_reviews(reviews))
    return good.select("product_id", "customer_id", "rating", "review_date", "helpful_votes", "verified_purchase", F.length("review_body").alias("body_chars"), F.length("review_title").alias("title_chars"), "sentiment")


RAW = ("m_customers", "m_products", "m_orders", "m_items", "m_payments", "m_reviews", "m_events")


def raw_tables(customers, products, orders, items, payments, reviews, events) -> dict[str, DataFrame]:
    return {"customers": dirty_customers(customers), "products": dirty_products(products), "orders": dirty_orders(orders), "order_items": dirty_items(items), "payments": dirty_payments(payments), "reviews": dirty_reviews(reviews), "clickstream": dirty_events(events)}


REPORT = DIRTY_CUSTOMERS + ",\n" + DIRTY_PRODUCTS + ",\n" + DIRTY_PAYMENTS + ",\n" + DIRTY_REVIEWS + """,
t AS (SELECT *, CASE WHEN order_id % 23 = 0 THEN 0 WHEN order_id % 29 = 0 THEN -1 ELSE 1 END s, CASE WHEN order_id % 5 = 0 THEN 'odd' ELSE status END st FROM m_orders),
n AS (SELECT 'customers' tbl, count(*) total, count(*) FILTER (NOT (d OR n OR b OR w OR y)) valid FROM f UNION ALL SELECT 'products', count(*), count(*) FILTER (p > 0) FROM dp UNION ALL SELECT 'orders', count(*), count(*) FILTER (s >= 0) FROM t
 UNION ALL SELECT 'payments', (SELECT count(*) FROM m_payments) + (SELECT count(*) FROM m_payments WHERE payment_id % 5 = 0), count(*) FILTER (amt IS NOT NULL) FROM y UNION ALL SELECT 'reviews', (SELECT count(*) FROM m_reviews), count(*) FILTER (r IS NOT NULL) FROM v1
 UNION ALL SELECT 'clickstream', 2 * count(*), count(*) FILTER (event_id % 10 <> 0) FROM m_events)
"""
ISSUES = """, i AS (SELECT 'customers' tbl, 'duplicate_customer_id' AS rule, count(*) FILTER (d) n FROM f UNION ALL SELECT 'customers', 'null_email', count(*) FILTER (NOT d AND n) FROM f UNION ALL SELECT 'customers', 'invalid_email_format', count(*) FILTER (NOT (d OR n) AND b) FROM f
 UNION ALL SELECT 'customers', 'future_registration_date', count(*) FILTER (NOT (d OR n OR b) AND w) FROM f UNION ALL SELECT 'customers', 'dob_too_young', count(*) FILTER (NOT (d OR n OR b OR w) AND y) FROM f
 UNION ALL SELECT 'products', 'non_positive_unit_price', count(*) FILTER (p <= 0) FROM dp UNION ALL SELECT 'products', 'negative_cost_price', count(*) FILTER (c < 0) FROM gp UNION ALL SELECT 'products', 'inverted_margin', count(*) FILTER (c2 > p) FROM gp
 UNION ALL SELECT 'orders', 'negative_total_amount', count(*) FILTER (s < 0) FROM t UNION ALL SELECT 'orders', 'invalid_status', count(*) FILTER (s >= 0 AND st = 'odd') FROM t
 UNION ALL SELECT 'payments', 'null_amount', count(*) FILTER (amt IS NULL) FROM y
 UNION ALL SELECT 'reviews', 'invalid_rating', count(*) FILTER (r IS NULL) FROM v1
 UNION ALL SELECT 'clickstream', 'null_timestamp', count(*) FILTER (event_id % 10 = 0) FROM m_events)
"""


@query("run_etl_report", RAW, REPORT + ISSUES + """SELECT tbl AS "table", total AS total_rows, valid AS valid_rows, round(valid * 100.0::DOUBLE / greatest(total, 1), 2) AS pass_rate, rule, i.n AS n FROM n JOIN i USING (tbl)
WHERE i.n > 0 OR rule NOT IN ('null_email', 'future_registration_date', 'dob_too_young', 'duplicate_customer_id')""")
def _(*raw):
    """Of customers only the address format is reported at 0; other tables don't report duplicates."""
    at = raw[0].sparkSession
    _, report = clean.run_etl(raw_tables(*raw), AS_OF, new_path(at, "clean"))
    files.write_dq_report(report, path := new_path(at, "dq-report"))
    back = at.read.schema(quality.REPORT).json(path)
    return back.select("table", "total_rows", "valid_rows", "pass_rate", F.explode("issues").alias("i")).select("table", "total_rows", "valid_rows", "pass_rate", F.col("i.rule").alias("rule"), F.col("i.count").alias("n"))


@query("q24_etl_totals", RAW, REPORT + "SELECT CAST(sum(total) AS BIGINT) AS rows_in, CAST(sum(valid) AS BIGINT) AS rows_out, round(sum(valid) * 100.0::DOUBLE / greatest(sum(total), 1), 2) AS pass_rate FROM n")
def _(*raw):
    _, report = clean.run_etl(raw_tables(*raw), AS_OF)
    return quality.dq_totals(report)


# ---- warehouse ---------------------------------------------------------------


@query("w2_scd2_customer_stage", ("m_customers",), """WITH b AS (SELECT customer_id i, full_name, country, city, segment, CAST(DATE '2001-12-31' - CAST(customer_id * 37 % 30000 AS INTEGER) AS DATE) born FROM m_customers),
o AS (SELECT i, 'ann ' || i AS fn, i || '@old.io' AS email, city, country, segment, '45-54' AS ag FROM b WHERE i % 10 <> 0),
s AS (SELECT i, trim('Ann ' || CASE WHEN i % 3 = 0 THEN '' ELSE i || '' END) AS fn, i || CASE WHEN i % 4 = 0 THEN '@new.io' ELSE '@old.io' END AS email, city, country, CASE WHEN i % 6 = 0 THEN NULL ELSE segment END segment,
 CASE WHEN 2001 - year(born) < 25 THEN '18-24' WHEN 2001 - year(born) < 35 THEN '25-34' WHEN 2001 - year(born) < 45 THEN '35-44' WHEN 2001 - year(born) < 55 THEN '45-54' ELSE '55+' END AS ag FROM b WHERE i % 7 <> 0),
j AS (SELECT o.i oi, s.i si, o.i IS NOT NULL AND s.i IS NOT NULL AND (o.email IS DISTINCT FROM s.email OR o.segment IS DISTINCT FROM s.segment) ch FROM o FULL JOIN s ON o.i = s.i)
SELECT o.i AS customer_id, o.fn AS full_name, o.email, o.city, o.country, o.segment, o.ag AS age_group, DATE '2000-01-01' AS start_date, CASE WHEN ch THEN DATE '2001-12-31' END AS end_date, NOT ch AS is_current FROM j JOIN o ON o.i = j.oi
UNION ALL SELECT s.i, s.fn, s.email, s.city, s.country, s.segment, s.ag, DATE '2001-12-31', NULL, true FROM j JOIN s ON s.i = j.si WHERE oi IS NULL OR ch""")
def _(customers):
    i = F.col("customer_id")
    stage = customers.select(
        i, F.lit("Ann").alias("first_name"), F.when(i % 3 != 0, i.cast("string")).alias("last_name"), F.concat(i.cast("string"), F.when(i % 4 == 0, "@new.io").otherwise("@old.io")).alias("email"), "city", "country", F.when(i % 6 != 0, F.col("segment")).alias("segment"),
        F.date_sub(F.lit("2001-12-31").cast("date"), (i * 37 % 30000).cast("int")).alias("date_of_birth"), F.when(i % 7 == 0, F.lit("2001-12-30 10:59:59")).otherwise(F.lit("2001-12-30 11:00:00")).cast("timestamp").alias("_load_timestamp"),
    )
    current = customers.filter(i % 10 != 0).select(i, F.concat(F.lit("ann "), i.cast("string")).alias("full_name"), F.concat(i.cast("string"), F.lit("@old.io")).alias("email"), "city", "country", "segment", F.lit("45-54").alias("age_group"), F.lit("2000-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    return warehouse.scd2_customer(current, stage, AS_OF, loaded_at="2001-12-31 12:00:00")


@query("w3_scd2_product", ("m_products",), """WITH c AS (SELECT category_name, row_number() OVER (ORDER BY category_name) sk FROM (SELECT DISTINCT category_name FROM m_products)),
b AS (SELECT product_id i, product_name pn, CASE WHEN product_id % 8 = 0 THEN NULL ELSE sk END sk, brand, CAST(unit_price AS DOUBLE) up, CAST(cost_price AS DOUBLE) cp FROM m_products JOIN c USING (category_name)),
o AS (SELECT * FROM b WHERE i % 9 <> 0), s AS (SELECT i, pn, sk, brand, CASE WHEN i % 4 = 0 THEN up + 100 ELSE up END up, cp, i % 5 <> 0 AS act FROM b WHERE i % 11 <> 0),
j AS (SELECT o.i oi, s.i si, o.i IS NOT NULL AND s.i IS NOT NULL AND (o.up <> s.up OR NOT s.act) ch FROM o FULL JOIN s ON o.i = s.i)
SELECT i AS product_id, pn AS product_name, sk AS category_sk, brand, up AS unit_price, cp AS cost_price, 40.0::DOUBLE AS margin_pct, true AS is_active, DATE '2000-01-01' AS start_date, CASE WHEN ch THEN DATE '2001-12-31' END AS end_date, NOT ch AS is_current FROM j JOIN o ON o.i = j.oi
UNION ALL SELECT i, pn, sk, brand, up, cp, round((up - cp) * 100 / up, 2), act, DATE '2001-12-31', NULL, true FROM j JOIN s ON s.i = j.si WHERE oi IS NULL OR ch""")
def _(products):
    i = F.col("product_id")
    dim = warehouse.build_dim(products, ["category_name"], "category_sk").select("category_name", F.col("category_sk").cast("long").alias("category_sk"))
    rows = products.select(i, "product_name", F.when(i % 8 != 0, F.col("category_name")).alias("category_name"), "brand", F.col("unit_price").cast("double").alias("unit_price"), F.col("cost_price").cast("double").alias("cost_price"))
    stage = rows.filter(i % 11 != 0).withColumns({"unit_price": F.col("unit_price") + F.when(i % 4 == 0, 100).otherwise(0), "is_active": i % 5 != 0})
    old = rows.filter(i % 9 != 0).join(dim, "category_name", "left").select("product_id", "product_name", "category_sk", "brand", "unit_price", "cost_price", F.lit(40.0).alias("margin_pct"), F.lit(True).alias("is_active"), F.lit("2000-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    once = warehouse.scd2_product(old, stage, dim, AS_OF)
    return warehouse.scd2_product(once, stage, dim, AS_OF)


@query("w8_agg_clv", ("m_orders",))
def _(orders):
    return warehouse.agg_clv(A.clv_sql(orders))


ORACLE_SQL["w8_agg_clv"] = f"SELECT customer_id, frequency, revenue, aov, lifespan_days, clv_90d, clv_365d, tier FROM ({ORACLE_SQL['a3_clv_sql']})"


@query("w11_load_fact_clickstream", ("m_events", "m_customers"), """WITH ch AS (SELECT channel, row_number() OVER (ORDER BY channel) sk FROM (SELECT DISTINCT channel FROM m_events))
SELECT event_id, CAST(strftime(event_date, '%Y%m%d') AS INTEGER) AS event_date_key, c.customer_id * 2 AS customer_sk, sk AS channel_sk, event_type FROM m_events e LEFT JOIN m_customers c ON c.customer_id = e.customer_id LEFT JOIN ch USING (channel) WHERE event_id % 3 <> 0""")
def _(events, customers):
    dims = [(customers.select("customer_id", (F.col("customer_id") * 2).alias("customer_sk")), "customer_id"), (warehouse.build_dim(events, ["channel"], "channel_sk"), "channel")]
    fact = warehouse.load_fact(events, "event_date", "event_date_key", dims, events.filter("event_id % 3 = 0"), "event_id")
    return fact.select("event_id", "event_date_key", "customer_sk", F.col("channel_sk").cast("long").alias("channel_sk"), "event_type")


@query("w11_load_fact_reviews", ("m_reviews", "m_products"), "SELECT product_id, customer_id, CAST(rating AS BIGINT) AS rating, CAST(strftime(review_date, '%Y%m%d') AS INTEGER) AS review_date_key, product_id * 3 AS product_sk, brand FROM m_reviews LEFT JOIN m_products USING (product_id)")
def _(reviews, products):
    fact = warehouse.load_fact(reviews, "review_date", "review_date_key", [(products.select("product_id", (F.col("product_id") * 3).alias("product_sk"), "brand"), "product_id")])
    return fact.select("product_id", "customer_id", F.col("rating").cast("long").alias("rating"), "review_date_key", "product_sk", "brand")


@query("w12_dim_geography", ("m_customers",), "SELECT country, city, row_number() OVER (ORDER BY country || chr(31) || city) AS geo_sk FROM (SELECT DISTINCT country, city FROM m_customers)")
def _(customers):
    return warehouse.build_dim(customers, ["country", "city"], "geo_sk").select("country", "city", F.col("geo_sk").cast("long").alias("geo_sk"))


@query("w12_dim_payment_method", ("m_payments",), """WITH k AS (SELECT DISTINCT payment_method m FROM m_payments), e AS (SELECT m, row_number() OVER (ORDER BY m DESC) + 10 sk FROM k WHERE m < '3'), n AS (SELECT m, row_number() OVER (ORDER BY m) + (SELECT max(sk) FROM e) sk FROM k WHERE m >= '3')
SELECT m AS payment_method, CAST(sk AS BIGINT) AS method_sk FROM e UNION ALL SELECT m, CAST(sk AS BIGINT) FROM n""")
def _(payments):
    """Two methods have keys already, 12 and 11; new ones come above them."""
    from pyspark.sql import Window

    known = payments.select("payment_method").distinct().filter("payment_method < '3'").withColumn("method_sk", F.row_number().over(Window.orderBy(F.desc("payment_method"))) + 10)
    return warehouse.build_dim(payments, ["payment_method"], "method_sk", known).select("payment_method", F.col("method_sk").cast("long").alias("method_sk"))


@query("w14_w18_roles", ("m_customers",), """WITH r AS (SELECT customer_id, country, full_name fn, CASE WHEN customer_id % 5 <> 0 THEN 'u' || customer_id || '@shop' || customer_id % 3 || '.io' END e, '123-' || customer_id || '-789' p FROM m_customers)
SELECT 'DATA_ENGINEER' AS role, customer_id, country, fn AS full_name, e AS email, p AS phone FROM r UNION ALL SELECT 'SYSADMIN', customer_id, country, fn, e, p FROM r
UNION ALL SELECT 'DATA_ANALYST', customer_id, country, fn, '***' || substr(e, strpos(e, '@')), left(p, 3) || '****' || right(p, 2) FROM r
UNION ALL SELECT 'BI_USER', customer_id, country, '**REDACTED**', CASE WHEN e IS NOT NULL THEN '**REDACTED**' END, left(p, 3) || '****' || right(p, 2) FROM r WHERE country = 'ASIA'""")
def _(customers):
    i = F.col("customer_id").cast("string")
    rows = customers.select("customer_id", "country", "full_name", F.when(F.col("customer_id") % 5 != 0, F.concat(F.lit("u"), i, F.lit("@shop"), (F.col("customer_id") % 3).cast("string"), F.lit(".io"))).alias("email"), F.concat(F.lit("123-"), i, F.lit("-789")).alias("phone"))
    out = None
    for role in (governance.ENGINEER, governance.ADMIN, governance.ANALYST, governance.BI, "STRANGER"):
        seen = governance.row_access(governance.apply_masking(rows, role), role, "ASIA").withColumn("role", F.lit(role))
        out = seen if out is None else out.unionByName(seen)
    return out


# ---- files, written and read back -------------------------------------------

def _staged(orders: DataFrame) -> DataFrame:
    """Payment rows as they are staged: quotes, commas and every spelling of null."""
    i = F.col("order_id")
    note = F.element_at(F.array(F.concat(F.lit('say "hi", '), i), F.lit("NULL"), F.lit("null"), F.lit(""), F.concat(F.lit("n"), i)), F.least(i % 7 + 1, F.lit(5)).cast("int"))
    return orders.select(i.cast("string").alias("payment_id"), i.cast("string").alias("order_id"), F.col("order_date").cast("string").alias("payment_date"), note.alias("payment_method"), F.col("status").alias("payment_status"), F.col("total_amount").cast("string").alias("amount"), F.lit("null").alias("gateway"), F.lit("x").alias("transaction_ref"))


STAGED = "SELECT CAST(order_id AS VARCHAR) AS payment_id, CASE order_id % 7 WHEN 0 THEN 'say \"hi\", ' || order_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'n' || order_id END AS payment_method, status AS payment_status, CAST(total_amount AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS gateway FROM m_orders"


@query("s1_ingest_csv_to_parquet", ("m_orders",), STAGED)
def _(orders):
    spark = orders.sparkSession
    src, dst = new_path(spark, "raw"), new_path(spark, "ingested")
    files.write_csv(_staged(orders), f"{src}/payments.csv")
    counts = files.ingest_csv_to_parquet(spark, src, dst, ("payments", "reviews"))
    if list(counts) != ["payments"]:
        raise ValueError("one table was there")
    return files.read_parquet(spark, f"{dst}/payments").select("payment_id", "payment_method", "payment_status", "amount", "gateway")


@query("s2_s8_stage_csv", ("m_orders",), STAGED)
def _(orders):
    spark = orders.sparkSession
    files.write_csv(_staged(orders), path := new_path(spark, "csv"))
    return files.read_stage_csv(spark, path, schemas.PAYMENTS).select("payment_id", "payment_method", "payment_status", "amount", "gateway")


@query("s3_read_stage_json", ("m_customers",), "SELECT customer_id, full_name, country FROM m_customers")
def _(customers):
    """Arrays of the customers of one hash, a file each."""
    spark = customers.sparkSession
    rows = customers.groupBy((F.xxhash64("customer_id") % 32).alias("part")).agg(F.to_json(F.collect_list(F.struct("customer_id", "full_name", "country"))).alias("value"))
    rows.write.partitionBy("part").text(path := new_path(spark, "json"))
    return files.read_stage_json(spark, path, "customer_id long, full_name string, country string").select("customer_id", "full_name", "country")


@query("s4_load_new_files", ("m_orders",), "SELECT order_id, customer_id, CAST(0 AS BIGINT) AS load FROM m_orders WHERE order_id % 2 = 0 AND order_id % 31 <> 0 UNION ALL SELECT order_id, customer_id, 1 FROM m_orders WHERE order_id % 2 = 1 AND order_id % 31 <> 0 UNION ALL SELECT NULL, count(*), -1 FROM m_orders WHERE order_id % 31 = 0")
def _(orders):
    """Two loads of files and a third that finds none; rows that don't parse are counted, not loaded."""
    spark = orders.sparkSession
    src, dst, checkpoint = (new_path(spark, x) for x in ("incoming", "loaded", "load-checkpoint"))
    i = F.col("order_id")
    rows = orders.select(F.when(i % 31 == 0, F.lit("broken")).otherwise(i.cast("string")).alias("order_id"), "customer_id", (i % 2).alias("half"))
    for half in (0, 1):
        rows.filter(F.col("half") == half).drop("half").write.mode("append").option("header", True).csv(src)
        files.load_new_files(spark, src, "order_id long, customer_id long", dst, checkpoint)
    files.load_new_files(spark, src, "order_id long, customer_id long", dst, checkpoint)
    good = spark.read.parquet(f"{dst}/rows").select("order_id", "customer_id", F.col("load").cast("long").alias("load"))
    bad = spark.read.parquet(f"{dst}/bad").agg(F.lit(None).cast("long").alias("order_id"), F.count("*").alias("customer_id"), F.lit(-1).cast("long").alias("load"))
    return good.unionByName(bad)


@query("s5_with_load_metadata", ("m_orders",), "SELECT order_id, true AS has_file, true AS has_time, true AS own_number FROM m_orders")
def _(orders):
    spark = orders.sparkSession
    files.write_parquet(orders, path := new_path(spark, "orders"))
    rows = files.with_load_metadata(files.read_parquet(spark, path))
    numbers = rows.groupBy("_row_number").agg(F.count("*").alias("rows"))
    return rows.join(numbers, "_row_number").select("order_id", F.col("_source_file").endswith(".parquet").alias("has_file"), F.col("_load_timestamp").isNotNull().alias("has_time"), (F.col("rows") == 1).alias("own_number"))


@query("s7_s13_partitioned_refresh", ("m_orders",), "SELECT order_id, status, CASE WHEN month(order_date) = 6 THEN -1.0::DOUBLE ELSE CAST(total_amount AS DOUBLE) END AS total, date_trunc('month', order_date)::DATE AS month FROM m_orders WHERE NOT (month(order_date) = 6 AND order_id % 2 = 0)")
def _(orders):
    """Slices by month; those of June are written anew with half of their rows, the others stay."""
    spark = orders.sparkSession
    rows = orders.select("order_id", "status", F.col("total_amount").cast("double").alias("total"), F.trunc("order_date", "month").alias("month"))
    files.write_parquet(rows, path := new_path(spark, "slices"), "month")
    files.refresh_table(rows.filter("month(month) = 6 and order_id % 2 = 1").withColumn("total", F.lit(-1.0)), path, "month", dynamic=True)
    return spark.read.parquet(path).select("order_id", "status", "total", F.col("month").cast("date").alias("month"))


@query("s14_run_all_counts", ("m_orders", "m_items"))
def _(orders, items):
    found = batch.run_all({"orders": orders, "order_items": items}, new_path(orders.sparkSession, "marts"), AS_OF, rel_err=0)
    named = lambda df, what, key: df.select(F.lit(what).alias("what"), key.alias("name"), "rows")
    return named(found["segments"], "segment", F.col("segment")).unionByName(named(found["tiers"], "tier", F.col("tier"))).unionByName(named(found["pairs"], "pairs", F.lit("")))


ORACLE_SQL["s14_run_all_counts"] = f"""SELECT 'segment' AS what, segment AS name, rows FROM ({ORACLE_SQL["a12_segment_counts"]}) UNION ALL SELECT 'tier', tier, count(*) FROM ({ORACLE_SQL["a4_clv_batch"]}) GROUP BY tier
UNION ALL SELECT 'pairs', '', count(*) FROM ({ORACLE_SQL["a10_product_affinity"]})"""


# ---- streams -----------------------------------------------------------------


@query("s10_parse_kafka_value", ("m_events",), "SELECT CAST(event_id AS VARCHAR) AS event_id, session_id, CAST(customer_id AS VARCHAR) AS customer_id, event_type, product_id, CASE WHEN event_id % 8 <> 0 THEN event_timestamp END AS event_timestamp, device_type, event_timestamp + INTERVAL 1 SECOND AS kafka_timestamp FROM m_events")
def _(events):
    stamp = F.when(F.col("event_id") % 8 == 0, F.lit("never")).otherwise(F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "session_id", F.col("customer_id").cast("string").alias("customer_id"), "event_type", "product_id", stamp.alias("event_timestamp"), "device_type"))
    rows = event_sources.parse_kafka_value(events.select(body.cast("binary").alias("value"), (F.col("event_timestamp") + F.expr("interval 1 second")).alias("timestamp")))
    return rows.select("event_id", "session_id", "customer_id", "event_type", "product_id", "event_timestamp", "device_type", "kafka_timestamp")


#: Files of a folder are taken by their time of writing; all at once, none is late for another.
ALL = 1_000_000


def _event_files(events: DataFrame, parts: int = 4, more_in: str | None = None) -> tuple[str, str]:
    """Clickstream files in the order of time, in a folder of their own or beside those of ``more_in``, and a folder for what comes of them."""
    spark = events.sparkSession
    stamp = F.when(F.col("event_id") % 50 == 0, F.lit("broken")).otherwise(F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text = lambda c: F.col(c).cast("string").alias(c)
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = events.select(text("event_id"), "session_id", text("customer_id"), "event_type", none("page_url"), "product_id", stamp.alias("event_timestamp"), "device_type", none("browser"), none("referrer"), none("raw_json"))
    files.write_csv(rows.repartitionByRange(parts, "event_timestamp"), path := more_in or new_path(spark, "events"), "append")
    return path, new_path(spark, "streams")


@query("s11_s12_file_stream", ("m_events",), "SELECT CAST(event_id AS VARCHAR) AS event_id, session_id, event_type, event_timestamp, product_id FROM m_events WHERE event_id % 50 <> 0")
def _(events):
    """A folder as a stream of one file a batch into Parquet, started twice from one checkpoint: the second run adds nothing."""
    spark = events.sparkSession
    src, base = _event_files(events)
    for _ in range(2):
        sinks.start_sink(event_sources.file_events(spark, src), "file-events", "append", "parquet", f"{base}/checkpoint", f"{base}/rows", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("event_id", "session_id", "event_type", "event_timestamp", "product_id")


@query("s15_x5_run_streams", ("m_events",), "WITH g AS (SELECT session_id, CAST(customer_id AS VARCHAR) AS customer_id, count(*) AS n, 'HIGH_VELOCITY' AS alert, time_bucket(INTERVAL '5 minutes', event_timestamp) AS window_start FROM m_events WHERE event_id % 50 <> 0 GROUP BY ALL) SELECT * FROM g WHERE n > 1 AND window_start + INTERVAL 5 MINUTE <= (SELECT max(event_timestamp) - INTERVAL 5 MINUTE FROM m_events WHERE event_id % 50 <> 0)")
def _(events):
    """The streams started together under one deadline with all that is there; the velocity stream's table is returned, of windows that the watermark has closed."""
    spark = events.sparkSession
    src, base = _event_files(events)
    jobs = {"trending_products": stream.trending_products, "velocity_anomaly": lambda e: stream.velocity_anomaly(e, threshold=1)}
    sinks.run_streams(event_sources.file_events(spark, src, ALL), base, 3600, jobs=jobs, available_now=True)
    return spark.read.parquet(f"{base}/velocity_anomaly").select("session_id", "customer_id", "n", "alert", "window_start")


@query("x6_late_rows_dropped", ("m_events",), "WITH g AS (SELECT device_type, count(*) AS events, count(DISTINCT session_id) AS sessions, date_trunc('minute', event_timestamp) AS window_start FROM m_events WHERE event_id % 50 <> 0 AND event_id % 3 <> 0 GROUP BY ALL) SELECT * FROM g WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(event_timestamp) - INTERVAL 2 MINUTE FROM m_events WHERE event_id % 50 <> 0 AND event_id % 3 <> 0)")
def _(events):
    """Two thirds of the events, then, in a second run of the same query, the last third, which is late by days and dropped by the watermark."""
    spark = events.sparkSession
    src, base = _event_files(events.filter("event_id % 3 <> 0"))
    start = lambda: sinks.start_sink(stream.session_agg(event_sources.file_events(spark, src, ALL)), "sessions", "append", "parquet", f"{base}/checkpoint", f"{base}/rows", available_now=True).awaitTermination()
    start()
    last = events.filter("event_id % 3 <> 0 and event_id % 50 <> 0").agg(F.max("event_timestamp").alias("last"))
    late = events.filter("event_id % 3 = 0").join(F.broadcast(last)).filter(F.col("event_timestamp") < F.col("last") - F.expr("interval 1 day")).drop("last")
    _event_files(late, more_in=src)
    start()
    return spark.read.parquet(f"{base}/rows").select("device_type", "events", "sessions", "window_start")


# ---- recommendations ---------------------------------------------------------

FACTORS = """, u AS (SELECT customer_id, customer_id % 5 - 2 a, customer_id % 7 - 3 b, customer_id % 3 c FROM (SELECT DISTINCT customer_id FROM i)), p AS (SELECT product_id, product_id % 11 - 5 a, product_id % 4 b, product_id % 6 - 1 c FROM (SELECT DISTINCT product_id FROM i))
"""


def _fixed_factors(inter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small whole factors made of ids, in which ties are many."""
    c, p = F.col("customer_id"), F.col("product_id")
    floats = lambda *xs: F.array(*[x.cast("float") for x in xs]).alias("features")
    return inter.select(c).distinct().select(c, floats(c % 5 - 2, c % 7 - 3, c % 3)), inter.select(p).distinct().select(p, floats(p % 11 - 5, p % 4, p % 6 - 1))


@query("r5_top_n_fixed_factors", RECS, INTER + FACTORS + """, s AS (SELECT customer_id, product_id, CAST(u.a * p.a + u.b * p.b + u.c * p.c AS DOUBLE) score FROM u, p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.customer_id = u.customer_id AND i.product_id = p.product_id))
SELECT customer_id, product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM s) WHERE n <= 50""")
def _(items, orders, reviews):
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    return factors.top_by_factors(*_fixed_factors(inter), inter, 50)


@query("r4_rmse_fixed_factors", RECS, INTER + FACTORS + "SELECT round(sqrt(avg((least(score, 5.0::DOUBLE) - (u.a * p.a + u.b * p.b + u.c * p.c)) * (least(score, 5.0::DOUBLE) - (u.a * p.a + u.b * p.b + u.c * p.c)))), 6) AS rmse FROM i JOIN u USING (customer_id) JOIN p USING (product_id)")
def _(items, orders, reviews):
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    users, products = _fixed_factors(inter)
    dot = F.aggregate(F.zip_with("uf", "pf", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = inter.join(users.withColumnRenamed("features", "uf"), "customer_id").join(products.withColumnRenamed("features", "pf"), "product_id").select(F.least("score", F.lit(5.0)).alias("score"), dot.alias("prediction"))
    return factors.rmse(rows).select(F.round("rmse", 6).alias("rmse"))


RULES = """, d AS (SELECT DISTINCT order_id, product_id i FROM m_items), sg AS (SELECT i, count(*) n FROM d GROUP BY 1), tt AS (SELECT count(DISTINCT order_id) n FROM d),
pp AS (SELECT x.i a, y.i b, count(*) c FROM d x JOIN d y ON x.order_id = y.order_id AND x.i <> y.i GROUP BY 1, 2), rl AS (SELECT a, b, c::DOUBLE / tt.n support, c::DOUBLE / sa.n confidence, c::DOUBLE * tt.n / (sa.n::DOUBLE * sb.n) lift FROM pp JOIN sg sa ON sa.i = a JOIN sg sb ON sb.i = b, tt WHERE c::DOUBLE / tt.n >= 0.00001 AND c::DOUBLE / sa.n >= 0.1 AND c::DOUBLE * tt.n / (sa.n::DOUBLE * sb.n) >= 1.0)
"""


@query("r10_product_rules", ("m_items",), RULES.replace(", d AS", "WITH d AS", 1) + "SELECT a AS antecedent, b AS consequent, support, confidence, lift FROM rl")
def _(items):
    return basket.association_rules(items, min_support=0.00001)


#: A list in place of the factorization's: what the customer before has bought.
NEIGHBOUR = ", cf AS (SELECT customer_id + 1 AS customer_id, product_id, score FROM i)"


def _neighbours(inter: DataFrame) -> DataFrame:
    return inter.select((F.col("customer_id") + 1).alias("customer_id"), "product_id", "score")


NORMAL = "SELECT customer_id, product_id, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END s FROM {0} WINDOW w AS (PARTITION BY customer_id)"


@query("r12_normalize", RECS, INTER + NEIGHBOUR + " SELECT customer_id, product_id, s AS score FROM (" + NORMAL.format("cf") + ")")
def _(items, orders, reviews):
    return hybrid.normalize(_neighbours(hybrid.interactions(items, orders, reviews)))


@query("r15_user_item_scores", RECS, INTER + NEIGHBOUR + " SELECT customer_id, product_id, score, 'v1' AS model_version, 'cf' AS algorithm FROM cf UNION ALL SELECT customer_id, product_id, s, 'v1', 'normal' FROM (" + NORMAL.format("cf") + ")")
def _(items, orders, reviews):
    near = _neighbours(written(hybrid.interactions(items, orders, reviews), "interactions"))
    return hybrid.user_item_scores(cf=near, normal=hybrid.normalize(near))


@query("r13_blend_of_fixed_lists", (*RECS, "m_products"), INTER + ", " + TFIDF + RULES + NEIGHBOUR + """, hh AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_date DESC, product_id DESC) n FROM i), h AS (SELECT customer_id, product_id FROM hh WHERE n <= 10), h3 AS (SELECT customer_id, product_id FROM hh WHERE n <= 3),
mv AS (SELECT customer_id, token, sum(weight) / (SELECT count(*) FROM h h2 WHERE h2.customer_id = h.customer_id) m FROM h JOIN x USING (product_id) GROUP BY customer_id, token),
c0 AS (SELECT customer_id, product_id, round(sum(m * weight), 9) score FROM mv JOIN x USING (token) GROUP BY 1, 2),
ct AS (SELECT customer_id, product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM c0 WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.customer_id = c0.customer_id AND i.product_id = c0.product_id)) WHERE n <= 50),
r0 AS (SELECT customer_id, b product_id, max(lift * confidence) score FROM h3 JOIN rl ON a = product_id WHERE NOT EXISTS (SELECT 1 FROM h3 h2 WHERE h2.customer_id = h3.customer_id AND h2.product_id = b) GROUP BY 1, 2),
rr AS (SELECT customer_id, product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM r0) WHERE n <= 30),
ps AS (SELECT product_id, sum(score) s FROM i GROUP BY 1), po AS (SELECT m_products.product_id, product_name, category_name, coalesce(s / (SELECT max(s) FROM ps), 0) pop FROM m_products LEFT JOIN ps USING (product_id)),
a1 AS (""" + NORMAL.format("cf") + "), a2 AS (" + NORMAL.format("ct") + "), a3 AS (" + NORMAL.format("rr") + """),
al AS (SELECT cu.customer_id, po.product_id, product_name, category_name, coalesce(a1.s, 0) p0, coalesce(a2.s, 0) p1, coalesce(a3.s, 0) p2, pop FROM (SELECT DISTINCT customer_id FROM i UNION SELECT customer_id FROM cf) cu CROSS JOIN po LEFT JOIN a1 ON a1.customer_id = cu.customer_id AND a1.product_id = po.product_id LEFT JOIN a2 ON a2.customer_id = cu.customer_id AND a2.product_id = po.product_id LEFT JOIN a3 ON a3.customer_id = cu.customer_id AND a3.product_id = po.product_id
 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.customer_id = cu.customer_id AND i.product_id = po.product_id)),
fi AS (SELECT *, round(0.5::DOUBLE * p0 + 0.3::DOUBLE * p1 + 0.15::DOUBLE * p2 + 0.05::DOUBLE * pop, 6) score FROM al), rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM fi)
SELECT customer_id, product_id, product_name, category_name, score, CAST(n AS INTEGER) AS rank, CASE WHEN p0 > 0.3 THEN 'Based on customers like you' WHEN p1 > 0.3 THEN 'Similar to items you bought' WHEN p2 > 0.3 THEN 'Frequently bought together' ELSE 'Trending in your category' END AS reason, 'hybrid_v1' AS algorithm FROM rk WHERE n <= 10""")
def _(items, orders, reviews, products):
    """The blend with a list that SQL can make in place of the factorization's, written out and read back."""
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    rules = basket.association_rules(items, min_support=0.00001)
    content = hybrid.content_recs(inter, hybrid.tfidf(hybrid.product_tokens(products), products))
    picks = hybrid.hybrid_recs(_neighbours(inter), content, hybrid.rule_recs(hybrid.history(inter, 3), rules), hybrid.popularity(inter, products), inter, products)
    write_recommendations(picks, rules, path := new_path(items.sparkSession, "recommendations"))
    return files.read_parquet(items.sparkSession, f"{path}/recommendations")
