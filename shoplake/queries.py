"""Registered queries on the test tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplake.functions.cluster import ship_package
from shoplake.functions.store import written
from shoplake.jobs import analytics as A
from shoplake.jobs import clean, warehouse
from shoplake.operators import basket, governance, quality, scd
from shoplake.recs import factors, hybrid
from shoplake.recs.run import recommend_all
from shoplake.sources.fixtures import ctes, model
from shoplake.streaming import jobs as stream

AS_OF = "2001-12-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    """Register a query over model tables ``uses``, with SQL that may name them."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(*[model(spark, sf_dir, u) for u in uses])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            head = ctes(*uses)
            ORACLE_SQL[name] = head + (",\n" + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)
        return fn

    return add


def segment_sql(table: tuple) -> str:
    """The library's own table of score ranges as one CASE."""
    fits = lambda column, r: f"{column} BETWEEN {r[0]} AND {r[1]}"
    return "CASE " + " ".join(f"WHEN {fits('r_score', r)} AND {fits('f_score', f)} AND {fits('m_score', m)} THEN '{name}'" for name, r, f, m in table) + f" ELSE '{A.OTHER_SEGMENT}' END"


def half_up_sql(n: str, d: str, digits: int) -> str:
    """The ratio of two whole numbers, rounded half away from zero exactly, as decimals are; null over zero."""
    return f"CAST(CASE WHEN ({d}) <> 0 THEN sign({n}) * sign({d}) * ((2 * abs(CAST({n} AS HUGEINT)) * {10**digits} + abs({d})) // (2 * abs(CAST({d} AS HUGEINT)))) END AS DOUBLE) / {10**digits}.0::DOUBLE"


RFM_BASE = """b AS (SELECT customer_id, count(*) frequency, sum(net_revenue) monetary, min(order_date) first_order, max(order_date) last_order,
 date_diff('day', max(order_date), DATE '2001-12-31') recency FROM m_orders WHERE {where} GROUP BY customer_id)"""
RFM_QUANTILE = f"""WITH {RFM_BASE.format(where="status IN ('COMPLETED', 'SHIPPED')")},
c AS (SELECT quantile_disc(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) r, quantile_disc(CAST(frequency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) f, quantile_disc(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) m FROM b),
s AS (SELECT b.*, CASE WHEN recency <= r[1] THEN 5 WHEN recency <= r[2] THEN 4 WHEN recency <= r[3] THEN 3 WHEN recency <= r[4] THEN 2 ELSE 1 END r_score,
 CASE WHEN frequency >= f[4] THEN 5 WHEN frequency >= f[3] THEN 4 WHEN frequency >= f[2] THEN 3 WHEN frequency >= f[1] THEN 2 ELSE 1 END f_score,
 CASE WHEN CAST(monetary AS DOUBLE) >= m[4] THEN 5 WHEN CAST(monetary AS DOUBLE) >= m[3] THEN 4 WHEN CAST(monetary AS DOUBLE) >= m[2] THEN 3 WHEN CAST(monetary AS DOUBLE) >= m[1] THEN 2 ELSE 1 END m_score FROM b, c),
g AS (SELECT *, {segment_sql(A.SEGMENTS)} AS segment FROM s) """


@query("a1_rfm_quantile", ("m_orders",), RFM_QUANTILE + "SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) monetary, first_order, last_order, r_score, f_score, m_score, r_score || '' || f_score || '' || m_score AS rfm_code, segment FROM g")
def _(orders):
    return A.rfm_quantile(orders, AS_OF, rel_err=0)


@query("a12_segment_counts", ("m_orders",), RFM_QUANTILE + "SELECT segment, count(*) AS rows FROM g GROUP BY segment")
def _(orders):
    return A.segment_counts(A.rfm_quantile(orders, AS_OF, rel_err=0), "segment")


def _ntile_sql(r: str, fm: str) -> str:
    return f"""WITH {RFM_BASE.format(where="status NOT IN ('CANCELLED', 'REFUNDED')")},
s AS (SELECT *, CAST(ntile(5) OVER (ORDER BY recency {r}, customer_id) AS INTEGER) r_score, CAST(ntile(5) OVER (ORDER BY frequency {fm}, customer_id) AS INTEGER) f_score, CAST(ntile(5) OVER (ORDER BY monetary {fm}, customer_id) AS INTEGER) m_score FROM b)
SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) monetary, r_score, f_score, m_score, r_score || '' || f_score || '' || m_score AS rfm_code,
 {segment_sql(A.SEGMENTS_8)} AS segment FROM s"""


@query("a2_rfm_ntile", ("m_orders",), _ntile_sql("DESC", "ASC"))
def _(orders):
    return A.rfm_ntile(orders, AS_OF)


@query("a2_rfm_ntile_literal", ("m_orders",), _ntile_sql("ASC", "DESC"))
def _(orders):
    return A.rfm_ntile(orders, AS_OF, "literal")


TIER = "CASE WHEN {0} >= 5000 THEN 'Platinum' WHEN {0} >= 2000 THEN 'Gold' WHEN {0} >= 500 THEN 'Silver' ELSE 'Bronze' END AS tier"


@query("a3_clv_sql", ("m_orders",), f"""WITH b AS (SELECT customer_id, count(*) frequency, CAST(sum(net_revenue) AS DOUBLE) revenue, min(order_date) first_order, max(order_date) last_order, date_diff('day', min(order_date), max(order_date)) lifespan_days FROM m_orders WHERE status NOT IN ('CANCELLED', 'REFUNDED') GROUP BY customer_id),
c AS (SELECT *, revenue / frequency aov, CAST(frequency AS DOUBLE) / nullif(ceil(lifespan_days / 30.0), 0) monthly_frequency FROM b)
SELECT customer_id, frequency, revenue, aov, first_order, last_order, lifespan_days, monthly_frequency, aov * monthly_frequency * 12 * 0.65::DOUBLE AS clv_365d, aov * monthly_frequency * 3 * 0.65::DOUBLE AS clv_90d, {TIER.format("aov * monthly_frequency * 12 * 0.65::DOUBLE")} FROM c""")
def _(orders):
    return A.clv_sql(orders)


@query("a4_clv_batch", ("m_orders",), f"""WITH b AS (SELECT customer_id, count(*) frequency, CAST(sum(net_revenue) AS DOUBLE) revenue, date_diff('day', min(order_date), max(order_date)) + 1 lifespan_days FROM m_orders WHERE status IN ('COMPLETED', 'SHIPPED') GROUP BY customer_id),
c AS (SELECT *, revenue / frequency a, round(frequency / greatest(lifespan_days / 30.0::DOUBLE, 1.0::DOUBLE), 4) monthly_frequency FROM b)
SELECT customer_id, frequency, revenue, lifespan_days, monthly_frequency, round(a, 2) AS aov, round(a * monthly_frequency * 12 * 0.65::DOUBLE, 2) AS clv_365d, {TIER.format("a * monthly_frequency * 12 * 0.65::DOUBLE")} FROM c""")
def _(orders):
    return A.clv_batch(orders)


@query("a5_cohort_retention", ("m_orders",), """WITH a AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) m FROM m_orders), f AS (SELECT customer_id, min(m) c FROM a GROUP BY 1),
n AS (SELECT c AS cohort_month, date_diff('month', c, m) AS period, count(*) customers FROM a JOIN f USING (customer_id) GROUP BY 1, 2)
SELECT n.cohort_month, n.period, n.customers, s.customers AS cohort_size, round(n.customers * 100.0::DOUBLE / s.customers, 1) AS retention_pct FROM n JOIN n s ON s.cohort_month = n.cohort_month AND s.period = 0""")
def _(orders):
    return A.cohort_retention(orders)


@query("a6_revenue_growth", ("m_orders",), """WITH q AS (SELECT year(order_date) y, month(order_date) m, sum(net_revenue) rev, count(*) orders, count(DISTINCT customer_id) customers FROM m_orders WHERE status NOT IN ('CANCELLED', 'REFUNDED') GROUP BY 1, 2),
l AS (SELECT *, lag(rev) OVER w prev, lag(rev, 12) OVER w py, sum(rev) OVER (PARTITION BY y ORDER BY m ROWS UNBOUNDED PRECEDING) ytd FROM q WINDOW w AS (ORDER BY y, m))
SELECT y AS year, m AS month, CAST(rev AS DOUBLE) AS revenue, orders, customers, CAST(rev AS DOUBLE) / orders AS aov, CAST(prev AS DOUBLE) AS prev_month, round(CAST((rev - prev) * 100 AS DOUBLE) / nullif(CAST(prev AS DOUBLE), 0), 2) AS mom_pct, round(CAST((rev - py) * 100 AS DOUBLE) / nullif(CAST(py AS DOUBLE), 0), 2) AS yoy_pct, CAST(ytd AS DOUBLE) AS ytd FROM l""")
def _(orders):
    return A.revenue_growth(orders)


@query("a7_product_performance", ("m_items", "m_products", "m_reviews"), """WITH s AS (SELECT product_id, CAST(sum(quantity) AS BIGINT) units, sum(line_total) rev FROM m_items GROUP BY 1), r AS (SELECT product_id, avg(rating) avg_rating, count(*) reviews FROM m_reviews GROUP BY 1),
j AS (SELECT product_id, category_name, units, rev, rev - units * cost_price mg, avg_rating, coalesce(reviews, 0) reviews FROM s JOIN m_products USING (product_id) LEFT JOIN r USING (product_id))
SELECT product_id, category_name, units, CAST(rev AS DOUBLE) AS revenue, CAST(mg AS DOUBLE) AS margin, CAST(mg AS DOUBLE) * 100 / nullif(CAST(rev AS DOUBLE), 0) AS margin_pct, avg_rating, reviews,
 rank() OVER (ORDER BY rev DESC) AS revenue_rank, rank() OVER (PARTITION BY category_name ORDER BY rev DESC) AS category_rank, percent_rank() OVER (ORDER BY rev) AS pct_rank,
 CAST(sum(rev) OVER (ORDER BY rev DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum_revenue, CAST(sum(rev) OVER (ORDER BY rev DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100 / CAST(sum(rev) OVER () AS DOUBLE) AS cum_pct FROM j""")
def _(items, products, reviews):
    return A.product_performance(items, products, reviews)


FUNNEL = ", ".join(f"count(DISTINCT CASE WHEN event_type = '{s}' THEN session_id END) AS {s}" for s in A.STEPS)


@query("a8_funnel_by_channel", ("m_events",), f"""WITH f AS (SELECT channel, {FUNNEL} FROM m_events GROUP BY channel)
SELECT *, round(product_view * 100.0::DOUBLE / nullif(page_view, 0), 2) AS view_to_product_pct, round(add_to_cart * 100.0::DOUBLE / nullif(product_view, 0), 2) AS product_to_cart_pct, round(checkout * 100.0::DOUBLE / nullif(add_to_cart, 0), 2) AS cart_to_checkout_pct, round(purchase * 100.0::DOUBLE / nullif(checkout, 0), 2) AS checkout_to_purchase_pct, round(purchase * 100.0::DOUBLE / nullif(page_view, 0), 2) AS overall_pct FROM f""")
def _(events):
    return A.funnel_by_channel(events)


@query("w9_funnel_daily", ("m_events",), f"""WITH f AS (SELECT event_date, {FUNNEL} FROM m_events GROUP BY event_date)
SELECT event_date, page_view, add_to_cart, checkout, purchase, round(purchase * 100.0::DOUBLE / nullif(page_view, 0), 2) AS overall_pct FROM f""")
def _(events):
    return A.funnel_daily(events)


def raw_events(events: DataFrame) -> DataFrame:
    """The clickstream with its JSON payload, made of event columns."""
    body = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","user_agent":{"device":"'), "device_type", F.lit('"},"geo":{"country":"C'), (F.col("customer_id") % 7).cast("string"), F.lit('"},"product":'), F.coalesce(F.concat(F.lit('{"id":"'), "product_id", F.lit('","price":'), F.col("value").cast("string"), F.lit("}")), F.lit("null")), F.lit(',"cart":{"items":["a,1","b"],"total":2.5},"session":{"duration_seconds":'), (F.col("event_id") % 600).cast("string"), F.lit("}}"))
    return events.withColumn("raw_json", body)


@query("a9_parse_payload", ("m_events",), """SELECT event_id, event_type, device_type AS device, 'C' || (customer_id % 7) AS country, product_id, CASE WHEN product_id IS NOT NULL THEN value END AS price, 'a,1,b' AS cart_items, CAST(2 AS BIGINT) AS cart_size, event_id % 600 AS seconds FROM m_events""")
def _(events):
    return A.parse_payload(raw_events(events), limit=None)


PAIRS = """WITH d AS (SELECT DISTINCT order_id, {item} AS i FROM m_items{join}), s AS (SELECT i, count(*) n FROM d GROUP BY i), t AS (SELECT count(DISTINCT order_id) n FROM d),
p AS (SELECT x.i a, y.i b, count(*) n_pair FROM d x JOIN d y ON x.order_id = y.order_id AND x.i < y.i GROUP BY 1, 2),
m AS (SELECT a, b, n_pair, t.n n, sa.n na, sb.n nb FROM p JOIN s sa ON sa.i = a JOIN s sb ON sb.i = b, t)
"""
AFFINITY = "SELECT a, b, n_pair, round(n_pair::DOUBLE / n, 6) AS support, round(n_pair::DOUBLE / na, 4) AS confidence, round(n_pair::DOUBLE * n / (na::DOUBLE * nb), 4) AS lift FROM m WHERE n_pair >= 3 AND round(n_pair::DOUBLE * n / (na::DOUBLE * nb), 4) > 1.0"


@query("a10_product_affinity", ("m_items",), PAIRS.format(item="product_id", join="") + AFFINITY)
def _(items):
    return basket.product_affinity(items)


@query("a10_brand_affinity", ("m_items", "m_products"), PAIRS.format(item="brand", join=" JOIN m_products USING (product_id)") + AFFINITY)
def _(items, products):
    return basket.product_affinity(items.join(products, "product_id"), item="brand")


@query("r10_association_rules", ("m_items", "m_products"), PAIRS.format(item="brand", join=" JOIN m_products USING (product_id)") + """, r AS (SELECT a antecedent, b consequent, n_pair::DOUBLE / n support, n_pair::DOUBLE / na confidence, n_pair::DOUBLE * n / (na::DOUBLE * nb) lift FROM m
 UNION ALL SELECT b, a, n_pair::DOUBLE / n, n_pair::DOUBLE / nb, n_pair::DOUBLE * n / (na::DOUBLE * nb) FROM m)
SELECT * FROM r WHERE support >= 0.0005 AND lift >= 1.0 AND confidence >= 0.1""")
def _(items, products):
    return basket.association_rules(items.join(products, "product_id"), item="brand", min_support=0.0005)


@query("a11_daily_kpis", ("m_orders",), f"""WITH k AS (SELECT order_date, channel, count(*) orders, round(sum(total_amount), 2) gross, round(sum(discount_amount), 2) discount, round(sum(tax_amount), 2) tax, round(sum(net_revenue), 2) net, count(DISTINCT customer_id) customers FROM m_orders GROUP BY 1, 2),
l AS (SELECT *, lag(net) OVER (PARTITION BY channel ORDER BY order_date) prev FROM k), c AS (SELECT *, CAST(net * 100 AS HUGEINT) nc, CAST(prev * 100 AS HUGEINT) pc FROM l)
SELECT order_date, channel, orders, CAST(gross AS DOUBLE) AS gross, CAST(discount AS DOUBLE) AS discount, CAST(tax AS DOUBLE) AS tax, CAST(net AS DOUBLE) AS net, {half_up_sql("nc", "orders * 100", 2)} AS aov, customers, CAST(prev AS DOUBLE) AS prev_net,
 {half_up_sql("(nc - pc) * 100", "pc", 2)} AS growth_pct FROM c""")
def _(orders):
    return A.daily_kpis(orders)


# ---- cleaning and quality -------------------------------------------------
# Dirty rows are made of the test tables: ids repeat, values are padded, broken or out of range.


@query("q1_dedupe_keep_first", ("m_items",), """SELECT order_id, product_id, quantity, CAST(line_total AS DOUBLE) AS line_total FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY quantity, product_id, line_total, gross) n FROM m_items) WHERE n = 1""")
def _(items):
    first = quality.dedupe_keep_first(items, ["order_id"], [F.col(c) for c in ("quantity", "product_id", "line_total", "gross")])
    return first.select("order_id", "product_id", "quantity", F.col("line_total").cast("double").alias("line_total"))


def dirty_customers(customers: DataFrame) -> DataFrame:
    i = F.col("customer_id")
    mail = F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.concat(F.lit(" pad"), i, F.lit("@shop.io"))).when(i % 13 == 0, F.lit("no-at.example")).otherwise(F.concat(F.lit("User"), i, F.lit("@Shop.io")))
    born = F.date_sub(F.lit("2001-12-31").cast("date"), (i * 37 % 30000).cast("int"))
    rows = customers.select(
        i.cast("string").alias("customer_id"), F.lit("ann").alias("first_name"), F.lit("\to'brien ").alias("last_name"), mail.alias("email"), born.cast("string").alias("date_of_birth"), F.lit(" F ").alias("gender"), "country",
        F.date_add("registration_date", F.when(i % 17 == 0, 4000).otherwise(0)).cast("string").alias("registration_date"), F.when(i % 3 != 0, F.col("segment")).alias("segment"), (i * 10).alias("_row_number"),
    )
    again = rows.filter("customer_id % 5 = 0").withColumn("_row_number", F.col("_row_number") + 1).withColumn("email", F.lit("second@copy.io"))
    return rows.unionByName(again)


DIRTY_CUSTOMERS = """WITH r AS (SELECT CAST(customer_id AS VARCHAR) customer_id, customer_id * 10 rn, country, CASE WHEN customer_id % 3 <> 0 THEN segment END segment,
 CASE WHEN customer_id % 11 = 0 THEN NULL WHEN customer_id % 7 = 0 THEN ' pad' || customer_id || '@shop.io' WHEN customer_id % 13 = 0 THEN 'no-at.example' ELSE 'User' || customer_id || '@Shop.io' END email,
 CAST(DATE '2001-12-31' - CAST(customer_id * 37 % 30000 AS INTEGER) AS DATE) born, CAST(registration_date + CAST(CASE WHEN customer_id % 17 = 0 THEN 4000 ELSE 0 END AS INTEGER) AS DATE) reg FROM m_customers),
u AS (SELECT * FROM r UNION ALL SELECT customer_id, rn + 1, country, segment, 'second@copy.io', born, reg FROM r WHERE CAST(customer_id AS BIGINT) % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY rn) > 1 d, email IS NULL n, NOT regexp_matches(coalesce(email, 'a@b.cc'), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') b, coalesce(reg > DATE '2001-12-31', false) w, date_diff('day', born, DATE '2001-12-31') < 5840 y FROM u)
"""


@query("clean_customers", ("m_customers",), DIRTY_CUSTOMERS + """, g AS (SELECT *, CAST(floor(date_diff('day', born, DATE '2001-12-31') / 365.25) AS INTEGER) age FROM f WHERE NOT (d OR n OR b OR w OR y))
SELECT customer_id, lower(email) AS email, 'Ann' AS first_name, 'O''Brien' AS last_name, 'f' AS gender, upper(country) AS country, coalesce(segment, 'Unknown') AS segment, reg AS registration_date, age,
 CASE WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34' WHEN age <= 44 THEN '35-44' WHEN age <= 54 THEN '45-54' ELSE '55+' END AS age_group FROM g""")
def _(customers):
    good, _ = clean.clean_customers(dirty_customers(customers), AS_OF)
    return good.select("customer_id", "email", "first_name", "last_name", "gender", "country", "segment", "registration_date", "age", "age_group")


@query("q23_dq_report", ("m_customers",), DIRTY_CUSTOMERS + """, c AS (SELECT count(*) total_rows, count(*) FILTER (NOT (d OR n OR b OR w OR y)) valid_rows, count(*) FILTER (d) c0, count(*) FILTER (NOT d AND n) c1, count(*) FILTER (NOT d AND NOT n AND b) c2, count(*) FILTER (NOT (d OR n OR b) AND w) c3, count(*) FILTER (NOT (d OR n OR b OR w) AND y) c4 FROM f)
SELECT total_rows, valid_rows, round(valid_rows * 100.0::DOUBLE / greatest(total_rows, 1), 2) AS pass_rate, rule, n FROM c, LATERAL (VALUES ('duplicate_customer_id', c0), ('null_email', c1), ('invalid_email_format', c2), ('future_registration_date', c3), ('dob_too_young', c4)) v(rule, n) WHERE n > 0""")
def _(customers):
    _, report = clean.clean_customers(dirty_customers(customers), AS_OF)
    return report.select("total_rows", "valid_rows", "pass_rate", F.explode("issues").alias("i")).select("total_rows", "valid_rows", "pass_rate", F.col("i.rule").alias("rule"), F.col("i.count").alias("n"))


@query("q24_dq_totals", ("m_customers",), DIRTY_CUSTOMERS + "SELECT 2 * count(*) AS rows_in, 2 * count(*) FILTER (NOT (d OR n OR b OR w OR y)) AS rows_out, round(count(*) FILTER (NOT (d OR n OR b OR w OR y)) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS pass_rate FROM f")
def _(customers):
    _, report = clean.clean_customers(dirty_customers(customers), AS_OF)
    return quality.dq_totals(report.unionByName(report)).select(F.col("rows_in").cast("long").alias("rows_in"), F.col("rows_out").cast("long").alias("rows_out"), "pass_rate")


def dirty_products(products: DataFrame) -> DataFrame:
    i = F.col("product_id")
    active = F.element_at(F.array(F.lit("TRUE"), F.lit("yes"), F.lit("no"), F.lit(None).cast("string")), (i % 4 + 1).cast("int"))
    return products.select(i, F.concat(F.lit("  "), "product_name", F.lit("\t")).alias("product_name"), "category_name", F.upper("brand").alias("brand"), (F.col("unit_price").cast("double") * F.when(i % 19 == 0, -1).otherwise(1)).cast("string").alias("unit_price"), (F.col("cost_price").cast("double") * F.when(i % 7 == 0, -1).when(i % 23 == 0, 2).otherwise(1)).cast("string").alias("cost_price"), active.alias("is_active"))


DIRTY_PRODUCTS = """dp AS (SELECT product_id, product_name, category_name, brand, CAST(unit_price AS DOUBLE) * (CASE WHEN product_id % 19 = 0 THEN -1 ELSE 1 END) p, CAST(cost_price AS DOUBLE) * (CASE WHEN product_id % 7 = 0 THEN -1 WHEN product_id % 23 = 0 THEN 2 ELSE 1 END) c FROM m_products),
gp AS (SELECT *, CASE WHEN c < 0 THEN p * 0.5::DOUBLE ELSE c END c2 FROM dp WHERE p > 0)
"""


@query("clean_products", ("m_products",), "WITH " + DIRTY_PRODUCTS + "SELECT product_id, product_name, category_name, p AS unit_price, c2 AS cost_price, round((p - c2) * 100 / p, 2) AS gross_margin_pct, product_id % 4 IN (0, 1) AS is_active FROM gp")
def _(products):
    good, _ = clean.clean_products(dirty_products(products))
    return good.select("product_id", "product_name", "category_name", "unit_price", "cost_price", "gross_margin_pct", "is_active")


def dirty_orders(orders: DataFrame) -> DataFrame:
    i = F.col("order_id")
    total = F.when(i % 23 == 0, F.lit("broken")).when(i % 29 == 0, (-F.col("total_amount")).cast("string")).otherwise(F.col("total_amount").cast("string"))
    return orders.select(i.cast("string").alias("order_id"), F.col("customer_id").cast("string").alias("customer_id"), F.col("order_date").cast("string").alias("order_date"), F.when(i % 5 == 0, F.lit("odd")).otherwise(F.col("status")).alias("status"), F.lit("0").alias("shipping_cost"), F.col("discount_amount").cast("string").alias("discount_amount"), F.col("tax_amount").cast("string").alias("tax_amount"), total.alias("total_amount"), F.lit("usd").alias("currency"), F.when(i % 3 != 0, F.col("channel")).alias("channel"))


def dirty_items(items: DataFrame) -> DataFrame:
    """Whole prices and percents, so that no product of them has half a cent; every ninth quantity and every eleventh total is broken."""
    i, price = F.col("product_id"), F.floor("gross").cast("long")
    pct = (F.col("discount") * 100).cast("int")
    total = F.round(F.col("quantity") * price * (100 - pct) / 100, 2)
    return items.select(F.col("order_id").cast("string").alias("order_id"), i.cast("string").alias("product_id"), F.when(i % 9 == 0, F.lit("many")).otherwise(F.col("quantity").cast("string")).alias("quantity"), price.cast("string").alias("unit_price"), pct.cast("string").alias("discount_pct"), F.when(i % 11 == 0, F.lit(None)).otherwise(total.cast("string")).alias("line_total"))


DIRTY_ITEMS = """di AS (SELECT order_id, product_id, CASE WHEN product_id % 9 = 0 THEN 1 ELSE quantity END q, CAST(floor(gross) AS BIGINT) price, CAST(discount * 100 AS INTEGER) pct, CASE WHEN product_id % 11 = 0 THEN 0.0::DOUBLE ELSE round(CAST(quantity * CAST(floor(gross) AS BIGINT) * (100 - CAST(discount * 100 AS INTEGER)) AS DOUBLE) / 100, 2) END line FROM m_items),
li AS (SELECT *, round(CAST(q * price * (100 - pct) AS DOUBLE) / 100, 2) chk FROM di)
"""


@query("clean_orders", ("m_orders", "m_items"), """SELECT CAST(order_id AS VARCHAR) AS order_id, CASE WHEN order_id % 5 = 0 THEN 'PENDING' ELSE status END AS status, CASE WHEN order_id % 3 = 0 THEN 'web' ELSE channel END AS channel, 'USD' AS currency, round(t - CAST(discount_amount AS DOUBLE), 2) AS net_revenue
FROM (SELECT *, CASE WHEN order_id % 23 = 0 THEN 0 WHEN order_id % 29 = 0 THEN -CAST(total_amount AS DOUBLE) ELSE CAST(total_amount AS DOUBLE) END t FROM m_orders) WHERE t >= 0""")
def _(orders, items):
    good, _, _ = clean.clean_orders(dirty_orders(orders), dirty_items(items))
    return good.select("order_id", "status", "channel", "currency", "net_revenue")


@query("q22_clean_order_items", ("m_orders", "m_items"), "WITH " + DIRTY_ITEMS + "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, CAST(q AS INTEGER) AS quantity, CAST(price AS DOUBLE) AS unit_price, CAST(pct AS DOUBLE) AS discount_pct, line AS line_total, chk AS line_total_check FROM li")
def _(orders, items):
    _, lines, _ = clean.clean_orders(dirty_orders(orders), dirty_items(items))
    return lines


@query("q22_line_total_mismatch", ("m_orders", "m_items"), "WITH " + DIRTY_ITEMS + "SELECT count(*) AS line_total_mismatch FROM li WHERE abs(line - chk) > 0.01")
def _(orders, items):
    return clean.line_total_mismatch(clean.clean_orders(dirty_orders(orders), dirty_items(items))[1])


def dirty_events(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    raw = events.select(i.cast("string").alias("event_id"), F.when(i % 6 == 0, F.lit("hover")).otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("event_type"), F.when(i % 4 == 0, F.lit("")).otherwise(F.col("customer_id").cast("string")).alias("customer_id"), F.when(i % 10 == 0, F.lit("bad time")).otherwise(F.col("event_timestamp").cast("string")).alias("event_timestamp"), F.lit(" Mobile ").alias("device_type"))
    return raw.unionByName(raw)


@query("clean_clickstream", ("m_events",), """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 6 = 0 THEN 'other' ELSE event_type END AS event_type, CASE WHEN event_id % 4 <> 0 THEN CAST(customer_id AS VARCHAR) END AS customer_id FROM m_events WHERE event_id % 10 <> 0""")
def _(events):
    good, _ = clean.clean_clickstream(dirty_events(events))
    return good.select("event_id", "event_type", "customer_id")


# ---- warehouse --------------------------------------------------------------


@query("w1_date_dim", ("m_orders",), """WITH d AS (SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM m_orders), (SELECT max(order_date) FROM m_orders), INTERVAL 1 DAY)) AS DATE) full_date)
SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key, full_date, CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter, CAST(month(full_date) AS INTEGER) AS month, strftime(full_date, '%b') AS month_name, CAST(weekofyear(full_date) AS INTEGER) AS week, CAST(day(full_date) AS INTEGER) AS day, CAST(dayofweek(full_date) AS INTEGER) AS weekday, strftime(full_date, '%a') AS day_name, dayofweek(full_date) IN (0, 6) AS is_weekend, CAST(year(full_date) AS INTEGER) AS fiscal_year, CAST(quarter(full_date) AS INTEGER) AS fiscal_quarter, CAST(month(full_date) AS INTEGER) AS fiscal_month FROM d""")
def _(orders):
    lo, hi = orders.agg(F.min("order_date"), F.max("order_date")).first()
    return warehouse.date_dim(orders.sparkSession, str(lo), (hi - lo).days + 1)


@query("w2_scd2_customer", ("m_customers",), """WITH o AS (SELECT customer_id, city, segment FROM m_customers WHERE customer_id % 10 <> 0),
n AS (SELECT customer_id, CASE WHEN customer_id % 4 = 0 THEN 'moved' ELSE city END city, CASE WHEN customer_id % 6 = 0 THEN NULL ELSE segment END segment FROM m_customers WHERE customer_id % 7 <> 0),
j AS (SELECT o.customer_id ok, n.customer_id nk, o.city oc, n.city nc, o.segment os, n.segment ns, o.customer_id IS NOT NULL AND n.customer_id IS NOT NULL AND (o.city IS DISTINCT FROM n.city OR o.segment IS DISTINCT FROM n.segment) ch FROM o FULL JOIN n ON o.customer_id = n.customer_id)
SELECT ok AS customer_id, oc AS city, os AS segment, DATE '2000-01-01' AS start_date, CASE WHEN ch THEN DATE '2001-12-31' END AS end_date, NOT ch AS is_current FROM j WHERE ok IS NOT NULL
UNION ALL SELECT nk, nc, ns, DATE '2001-12-31', NULL, true FROM j WHERE ok IS NULL OR ch""")
def _(customers):
    i = F.col("customer_id")
    old = customers.filter(i % 10 != 0).select(i, "city", "segment", F.lit("2000-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    new = customers.filter(i % 7 != 0).select(i, F.when(i % 4 == 0, "moved").otherwise(F.col("city")).alias("city"), F.when(i % 6 != 0, F.col("segment")).alias("segment"))
    once = scd.scd2_merge(old, new, "customer_id", ["city", "segment"], AS_OF)
    return scd.scd2_merge(once, new, "customer_id", ["city", "segment"], AS_OF)


@query("w13_as_of_join", ("m_orders", "m_customers"), """SELECT order_id, CASE WHEN order_date < DATE '1998-01-01' THEN 'early' ELSE country END AS country FROM m_orders JOIN m_customers USING (customer_id)""")
def _(orders, customers):
    early = customers.select("customer_id", F.lit("early").alias("country"), F.lit("1900-01-01").cast("date").alias("start_date"), F.lit("1998-01-01").cast("date").alias("end_date"))
    late = customers.select("customer_id", "country", F.lit("1998-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return scd.as_of_join(orders.select("order_id", "customer_id", "order_date"), early.unionByName(late), "customer_id", "order_date", "inner").select("order_id", "country")


@query("w10_surrogate_keys", ("m_products",), "SELECT category_name, row_number() OVER (ORDER BY category_name) AS sk FROM (SELECT DISTINCT category_name FROM m_products)")
def _(products):
    return warehouse.build_dim(products, ["category_name"], "sk").select("category_name", F.col("sk").cast("long").alias("sk"))


@query("w4_load_fact_orders", ("m_orders", "m_items", "m_customers"), """WITH c AS (SELECT order_id, count(*) n FROM m_items GROUP BY 1), ch AS (SELECT channel, row_number() OVER (ORDER BY channel) sk FROM (SELECT DISTINCT channel FROM m_orders)), g AS (SELECT country, city, min(customer_id) sk FROM m_customers GROUP BY 1, 2)
SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key, customer_id * 2 AS customer_sk, customer_id, ch.sk AS channel_sk, g.sk AS geo_sk, status, coalesce(n, 0) AS item_count, CAST(total_amount - discount_amount - shipping_cost AS DOUBLE) AS net_revenue
FROM m_orders JOIN m_customers USING (customer_id) LEFT JOIN ch USING (channel) LEFT JOIN g USING (country, city) LEFT JOIN c USING (order_id) WHERE order_id % 3 <> 0""")
def _(orders, items, customers):
    dim = customers.select("customer_id", (F.col("customer_id") * 2).alias("customer_sk"), "country", "city", F.lit(True).alias("is_current"))
    channels = warehouse.build_dim(orders, ["channel"], "channel_sk")
    geo = customers.select("country", "city", F.col("customer_id").alias("geo_sk"))
    done = orders.filter("order_id % 3 = 0").select("order_id")
    fact = warehouse.load_fact_orders(orders.unionByName(orders), items, dim, channels, geo, done)
    return fact.select("order_id", "order_date_key", "customer_sk", "customer_id", F.col("channel_sk").cast("long").alias("channel_sk"), "geo_sk", "status", "item_count", F.col("net_revenue").cast("double").alias("net_revenue"))


@query("w11_load_fact_items", ("m_items", "m_orders", "m_products"), """SELECT order_id, product_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key, quantity, CAST(line_total AS DOUBLE) AS line_revenue, CAST(quantity * cost_price AS DOUBLE) AS line_cost, CAST(line_total - quantity * cost_price AS DOUBLE) AS line_margin FROM m_items JOIN m_orders USING (order_id) LEFT JOIN m_products USING (product_id)""")
def _(items, orders, products):
    fact = warehouse.load_fact_items(items, orders, products.select("product_id", F.col("product_id").alias("product_sk"), "cost_price"))
    return fact.select("order_id", "product_id", "order_date_key", "quantity", *[F.col(c).cast("double").alias(c) for c in ("line_revenue", "line_cost", "line_margin")])


@query("w11_load_fact_payments", ("m_payments", "m_orders"), "SELECT payment_id, customer_id, payment_method, CAST(amount AS DOUBLE) AS amount, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS payment_date_key FROM m_payments JOIN m_orders USING (order_id) WHERE payment_id % 4 <> 0")
def _(payments, orders):
    dated = payments.join(orders.select("order_id", "order_date", "customer_id"), "order_id")
    fact = warehouse.load_fact(dated, "order_date", "payment_date_key", [], payments.filter("payment_id % 4 = 0"), "payment_id")
    return fact.select("payment_id", "customer_id", "payment_method", F.col("amount").cast("double").alias("amount"), "payment_date_key")


@query("w5_agg_daily_revenue", ("m_orders", "m_customers"), """SELECT order_date, channel, country, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS gross, CAST(sum(discount_amount) AS DOUBLE) AS discount, CAST(sum(tax_amount) AS DOUBLE) AS tax, CAST(sum(net_revenue) AS DOUBLE) AS net, CAST(sum(net_revenue) AS DOUBLE) / count(*) AS aov,
 count(DISTINCT CASE WHEN registration_date = order_date THEN customer_id END) AS new_customers, count(DISTINCT CASE WHEN registration_date < order_date THEN customer_id END) AS returning_customers, CAST(NULL AS DOUBLE) AS conversion_rate FROM m_orders JOIN m_customers USING (customer_id) GROUP BY 1, 2, 3""")
def _(orders, customers):
    return warehouse.agg_daily_revenue(orders, customers)


@query("w6_agg_product_monthly", ("m_items", "m_orders", "m_products", "m_reviews", "m_events"), """WITH s AS (SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) m, CAST(sum(quantity) AS BIGINT) u, CAST(sum(line_total) AS DOUBLE) rev, CAST(sum(quantity * cost_price) AS DOUBLE) cost, CAST(sum(CASE WHEN status IN ('REFUNDED', 'CANCELLED') THEN quantity ELSE 0 END) AS BIGINT) b FROM m_items JOIN m_orders USING (order_id) JOIN m_products USING (product_id) GROUP BY 1, 2),
r AS (SELECT product_id, CAST(date_trunc('month', review_date) AS DATE) m, avg(rating) a, count(*) n FROM m_reviews GROUP BY 1, 2),
e AS (SELECT CAST(product_id AS BIGINT) product_id, CAST(date_trunc('month', event_date) AS DATE) m, count(*) FILTER (event_type = 'product_view') v, count(*) FILTER (event_type = 'add_to_cart') c, count(*) FILTER (event_type = 'purchase') p FROM m_events WHERE product_id IS NOT NULL GROUP BY 1, 2)
SELECT product_id, m AS month, coalesce(u, 0) AS units, rev AS revenue, cost, rev - cost AS margin, (rev - cost) * 100 / nullif(rev, 0) AS margin_pct, a AS avg_rating, coalesce(n, 0) AS reviews, coalesce(b, 0) * 100.0::DOUBLE / nullif(u, 0) AS return_rate, coalesce(v, 0) AS page_views, coalesce(c, 0) AS add_to_carts, coalesce(p, 0) * 100.0::DOUBLE / nullif(v, 0) AS conversion
FROM s FULL JOIN r USING (product_id, m) FULL JOIN e USING (product_id, m)""")
def _(items, orders, products, reviews, events):
    return warehouse.agg_product_monthly(items, orders, products, reviews, events)


@query("w7_agg_customer_rfm", ("m_orders", "m_customers"), RFM_QUANTILE + """, k AS (SELECT customer_id, CAST(sum(net_revenue) AS DOUBLE) / count(*) a, round(count(*) / greatest((date_diff('day', min(order_date), max(order_date)) + 1) / 30.0::DOUBLE, 1.0::DOUBLE), 4) fr FROM m_orders WHERE status IN ('COMPLETED', 'SHIPPED') GROUP BY 1)
SELECT g.customer_id, r_score, f_score, m_score, g.segment, full_name, city, country, c.segment AS market_segment, round(a * fr * 12 * 0.65::DOUBLE, 2) AS predicted_clv FROM g JOIN k USING (customer_id) LEFT JOIN m_customers c USING (customer_id)""")
def _(orders, customers):
    out = warehouse.agg_customer_rfm(A.rfm_quantile(orders, AS_OF, rel_err=0), A.clv_batch(orders), customers)
    return out.select("customer_id", "r_score", "f_score", "m_score", "segment", "full_name", "city", "country", "market_segment", "predicted_clv")


@query("w17_masking", ("m_customers",), "SELECT customer_id, '***@shop.io' AS email, '123****89' AS phone, full_name FROM m_customers WHERE country = 'ASIA'")
def _(customers):
    rows = customers.withColumns({"email": F.concat(F.lit("u"), F.col("customer_id").cast("string"), F.lit("@shop.io")), "phone": F.lit("123-456-789")})
    seen = governance.row_access(governance.apply_masking(rows, governance.ANALYST), governance.BI, "ASIA")
    return seen.select("customer_id", "email", "phone", "full_name")


# ---- streaming jobs on batches ---------------------------------------------

SLIDE = "(SELECT e.*, time_bucket(INTERVAL '{s} minutes', event_timestamp) - INTERVAL 1 MINUTE * ({s} * k) ws FROM m_events e, range(0, {n}) r(k))"


@query("x1_session_agg", ("m_events",), "SELECT device_type, count(DISTINCT session_id) AS sessions, count(*) AS events, count(DISTINCT customer_id) AS users, date_trunc('minute', event_timestamp) AS window_start, date_trunc('minute', event_timestamp) + INTERVAL 1 MINUTE AS window_end FROM m_events GROUP BY device_type, date_trunc('minute', event_timestamp)")
def _(events):
    return stream.session_agg(events)


@query("x2_trending_products", ("m_events",), f"SELECT product_id, event_type, count(*) AS n, count(*) * CASE event_type WHEN 'purchase' THEN 10 WHEN 'add_to_cart' THEN 3 ELSE 1 END AS score, ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end FROM {SLIDE.format(s=1, n=5)} WHERE event_type IN ('product_view', 'add_to_cart', 'purchase') AND product_id IS NOT NULL GROUP BY product_id, event_type, ws")
def _(events):
    return stream.trending_products(events)


@query("x3_cart_abandonment", ("m_events",), f"SELECT session_id, customer_id, carts, CAST(0 AS BIGINT) AS purchases, n AS products, true AS abandonment_flag, ws AS window_start, ws + INTERVAL 10 MINUTE AS window_end FROM (SELECT session_id, customer_id, ws, count(*) FILTER (event_type = 'add_to_cart') carts, count(*) FILTER (event_type = 'purchase') p, count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN product_id END) n FROM {SLIDE.format(s=2, n=5)} GROUP BY 1, 2, 3) WHERE carts > 0 AND p = 0")
def _(events):
    return stream.cart_abandonment(events).select("session_id", "customer_id", "carts", "purchases", F.size("products").cast("long").alias("products"), "abandonment_flag", "window_start", "window_end")


@query("x4_live_funnel", ("m_events",), f"SELECT *, round(purchase * 100.0::DOUBLE / nullif(page_view, 0), 2) AS conversion_pct, window_start + INTERVAL 1 MINUTE AS window_end FROM (SELECT {FUNNEL}, date_trunc('minute', event_timestamp) AS window_start FROM m_events GROUP BY date_trunc('minute', event_timestamp))")
def _(events):
    return stream.live_funnel(events)


@query("x5_velocity_anomaly", ("m_events",), "SELECT session_id, customer_id, count(*) AS n, 'HIGH_VELOCITY' AS alert, time_bucket(INTERVAL '5 minutes', event_timestamp) AS window_start, time_bucket(INTERVAL '5 minutes', event_timestamp) + INTERVAL 5 MINUTE AS window_end FROM m_events GROUP BY session_id, customer_id, time_bucket(INTERVAL '5 minutes', event_timestamp) HAVING count(*) > 1")
def _(events):
    return stream.velocity_anomaly(events, threshold=1)


# ---- recommendations --------------------------------------------------------

INTER = """WITH q AS (SELECT order_id, product_id, sum(quantity) q FROM m_items GROUP BY 1, 2), b AS (SELECT customer_id, product_id, CAST(sum(q) AS BIGINT) quantity, max(order_date) last_date FROM q JOIN m_orders USING (order_id) GROUP BY 1, 2),
v AS (SELECT customer_id, product_id, avg(rating) r FROM m_reviews GROUP BY 1, 2), i AS (SELECT customer_id, product_id, quantity, coalesce(r, 3.0::DOUBLE) rating, round(quantity * (1 + ln(1 + coalesce(r, 3.0::DOUBLE))), 4) score, last_date FROM b LEFT JOIN v USING (customer_id, product_id))
"""
TFIDF = """t0 AS (SELECT product_id, unnest(regexp_split_to_array(lower(product_name || ' ' || category_name || ' ' || brand), '\\s+')) token FROM m_products), t AS (SELECT product_id, token, count(*) n FROM t0 WHERE length(token) > 2 GROUP BY 1, 2),
z AS (SELECT product_id, sum(n) al FROM t GROUP BY 1), vo AS (SELECT token, count(*) df FROM t GROUP BY 1 HAVING sum(n) >= 2), w AS (SELECT product_id, token, n::DOUBLE / al * (ln(((SELECT count(*) FROM m_products) + 1)::DOUBLE / (df + 1)) + 1) w FROM t JOIN vo USING (token) JOIN z USING (product_id)),
x AS (SELECT product_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM w)
"""
RECS = ("m_items", "m_orders", "m_reviews")


@query("r1_interactions", RECS, INTER + "SELECT * FROM i")
def _(items, orders, reviews):
    return hybrid.interactions(items, orders, reviews)


@query("r2_popularity", RECS, INTER + ", s AS (SELECT product_id, sum(score) s FROM i GROUP BY 1) SELECT product_id, s / (SELECT max(s) FROM s) AS popularity FROM s")
def _(items, orders, reviews):
    return hybrid.popularity(hybrid.interactions(items, orders, reviews))


@query("r6_product_tokens", ("m_products",), "WITH " + TFIDF + "SELECT * FROM t")
def _(products):
    return hybrid.product_tokens(products)


@query("r7_tfidf", ("m_products",), "WITH " + TFIDF + "SELECT * FROM x")
def _(products):
    return hybrid.tfidf(hybrid.product_tokens(products), products)


@query("r8_similar_products", ("m_products",), "WITH " + TFIDF + """, c AS (SELECT a.product_id, b.product_id other_id, round(sum(a.weight * b.weight), 9) similarity FROM x a JOIN x b ON a.token = b.token AND a.product_id <> b.product_id GROUP BY 1, 2)
SELECT product_id, other_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, other_id) n FROM c) WHERE n <= 10""")
def _(products):
    return hybrid.similar_products(hybrid.tfidf(hybrid.product_tokens(products), products))


@query("r9_content_recs", (*RECS, "m_products"), INTER + ", " + TFIDF + """, h AS (SELECT customer_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_date DESC, product_id DESC) n FROM i) WHERE n <= 10),
mv AS (SELECT customer_id, token, sum(weight) / (SELECT count(*) FROM h h2 WHERE h2.customer_id = h.customer_id) m FROM h JOIN x USING (product_id) GROUP BY customer_id, token),
sc AS (SELECT customer_id, product_id, round(sum(m * weight), 9) score FROM mv JOIN x USING (token) GROUP BY 1, 2)
SELECT customer_id, product_id, CAST(n AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM sc WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.customer_id = sc.customer_id AND i.product_id = sc.product_id)) WHERE n <= 50""")
def _(items, orders, reviews, products):
    recs = hybrid.content_recs(hybrid.interactions(items, orders, reviews), hybrid.tfidf(hybrid.product_tokens(products), products))
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("score"), "product_id"))
    return recs.select("customer_id", "product_id", place.alias("rank"), F.round("score", 6).alias("score"))


@query("r11_rule_recs", (*RECS,), INTER + """, d AS (SELECT DISTINCT order_id, product_id i FROM m_items), sg AS (SELECT i, count(*) n FROM d GROUP BY 1), tt AS (SELECT count(DISTINCT order_id) n FROM d),
pp AS (SELECT x.i a, y.i b, count(*) c FROM d x JOIN d y ON x.order_id = y.order_id AND x.i <> y.i GROUP BY 1, 2), rl AS (SELECT a, b, c::DOUBLE * tt.n / (sa.n::DOUBLE * sb.n) * (c::DOUBLE / sa.n) s FROM pp JOIN sg sa ON sa.i = a JOIN sg sb ON sb.i = b, tt WHERE c::DOUBLE / tt.n >= 0.00001 AND c::DOUBLE / sa.n >= 0.1 AND c::DOUBLE * tt.n / (sa.n::DOUBLE * sb.n) >= 1.0),
h AS (SELECT customer_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_date DESC, product_id DESC) n FROM i) WHERE n <= 3),
s AS (SELECT customer_id, b product_id, max(s) score FROM h JOIN rl ON a = product_id WHERE NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.customer_id = h.customer_id AND h2.product_id = b) GROUP BY 1, 2)
SELECT customer_id, product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) n FROM s) WHERE n <= 30""")
def _(items, orders, reviews):
    rules = basket.association_rules(items, min_support=0.00001)
    return hybrid.rule_recs(hybrid.history(hybrid.interactions(items, orders, reviews), 3), rules)


@query("r5_cf_top_n", RECS)
def _(items, orders, reviews):
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    return factors.cf_top_n(factors.train_cf(inter), inter)


@query("r4_cf_rmse", RECS)
def _(items, orders, reviews):
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    return factors.cf_rmse(factors.train_cf(inter), inter)


@query("r13_hybrid_recs", (*RECS, "m_products"))
def _(items, orders, reviews, products):
    picks, _ = recommend_all(items, orders, reviews, products)
    return picks
