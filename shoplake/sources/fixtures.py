"""The retail model derived from the test tables, as SQL that Spark and DuckDB both read.

Money is DECIMAL until the last step, so that both engines round alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name -> SQL over {table} placeholders of the base tables.
MODEL = {
    "sums": """SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(12,2)) * cast(l_discount AS decimal(4,2))) AS disc,
  sum(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))) * cast(l_tax AS decimal(4,2))) AS tax FROM {lineitem} GROUP BY l_orderkey""",
    "m_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, cast(o_orderdate AS date) AS order_date, o_orderpriority AS channel,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SHIPPED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'CANCELLED' ELSE 'PENDING' END END AS status,
  cast(o_totalprice AS decimal(12,2)) AS total_amount, cast(coalesce(disc, 0) AS decimal(12,2)) AS discount_amount, cast(coalesce(tax, 0) AS decimal(12,2)) AS tax_amount,
  cast(0 AS decimal(12,2)) AS shipping_cost, 'USD' AS currency,
  cast(cast(o_totalprice AS decimal(12,2)) - cast(coalesce(disc, 0) AS decimal(12,2)) AS decimal(13,2)) AS net_revenue
  FROM {orders} LEFT JOIN {sums} ON o_orderkey = l_orderkey""",
    "m_customers": """SELECT c_custkey AS customer_id, c_name AS full_name, n_name AS city, r_name AS country, c_mktsegment AS segment, f.first_date AS registration_date
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(cast(o_orderdate AS date)) AS first_date FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c_custkey""",
    "m_products": """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name, p_brand AS brand, cast(p_retailprice AS decimal(12,2)) AS unit_price,
  cast(cast(p_retailprice AS decimal(12,2)) * 0.6 AS decimal(12,2)) AS cost_price FROM {part}""",
    "m_items": """SELECT l_orderkey AS order_id, l_partkey AS product_id, cast(l_quantity AS bigint) AS quantity, cast(l_extendedprice AS decimal(12,2)) AS gross,
  cast(l_discount AS decimal(4,2)) AS discount, cast(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))) AS decimal(14,2)) AS line_total FROM {lineitem}""",
    "m_reviews": """SELECT l_partkey AS product_id, o_custkey AS customer_id, 1 + l_suppkey % 5 AS rating, cast(l_shipdate AS date) AS review_date
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "m_payments": """SELECT o_orderkey AS payment_id, o_orderkey AS order_id, o_orderpriority AS payment_method, cast(o_totalprice AS decimal(12,2)) AS amount
  FROM {orders} WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)""",
    "m_events": """SELECT event_id, ts AS event_timestamp, cast(ts AS date) AS event_date, user_id AS customer_id, cast(user_id AS varchar(20)) || '-' || cast(cast(ts AS date) AS varchar(10)) AS session_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'product_view' WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'checkout' ELSE event_type END AS event_type,
  nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS product_id, value,
  CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
  CASE user_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile_app' WHEN 2 THEN 'marketplace' WHEN 3 THEN 'social' ELSE 'email_campaign' END AS channel FROM {events}""",
}
USES = {"m_orders": ("sums",)}
BASE = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = MODEL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in sql}
    return spark.sql(sql, **tables, **{u: model(spark, sf_dir, u) for u in USES.get(name, ())})


def ctes(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the named model tables."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*USES.get(n, ()), n) if x not in wanted]
    tables = {t: t for t in (*BASE, *MODEL)}
    return "WITH " + ",\n".join(f"{n} AS ({MODEL[n].format(**tables)})" for n in wanted)
