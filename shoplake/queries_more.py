"""Registered queries of jobs that keep state: streams over restarts, loads with a ledger, merges and keys over several runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplake.functions.expr import date_key
from shoplake.functions.store import new_path
from shoplake.jobs import warehouse
from shoplake.jobs.clean import clean_click_stream
from shoplake.operators import scd
from shoplake.queries import AS_OF, FUNNEL, ORACLE_SQL, query
from shoplake.queries_jobs import ALL, _event_files
from shoplake.sources import events as event_sources
from shoplake.sources import ledger
from shoplake.streaming import carts, sinks
from shoplake.streaming import jobs as stream

# ---- streams -----------------------------------------------------------------

LEFT = """s AS (SELECT session_id, CAST(customer_id AS VARCHAR) customer_id, epoch_us(event_timestamp) us, event_type = 'purchase' b, product_id FROM m_events WHERE event_type IN ('add_to_cart', 'purchase') AND {where}),
o AS (SELECT *, lag(us) OVER w pat, lag(b) OVER w pb, lead(us) OVER w nat, lead(b) OVER w nb FROM s WINDOW w AS (PARTITION BY session_id, customer_id ORDER BY us, b)),
r AS (SELECT *, sum(CASE WHEN pat IS NULL OR pb OR us - pat > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, customer_id ORDER BY us, b ROWS UNBOUNDED PRECEDING) run FROM o WHERE NOT b),
g AS (SELECT session_id, customer_id, min(us) f, max(us) l, count(*) carts, array_to_string(list_sort(list(DISTINCT product_id) FILTER (product_id IS NOT NULL)), ',') products, bool_or(coalesce(nb AND nat - us <= 600000000, false)) bought FROM r GROUP BY session_id, customer_id, run),
a AS (SELECT session_id, customer_id, make_timestamp(f) AS first_cart, make_timestamp(l) AS last_cart, carts, coalesce(products, '') AS products FROM g WHERE NOT bought)
"""


def _alerts(df):
    return df.select("session_id", "customer_id", "first_cart", "last_cart", "carts", F.array_join("products", ",").alias("products"))


@query("x3_left_carts", ("m_events",), "WITH " + LEFT.format(where="true") + "SELECT * FROM a")
def _(events):
    return _alerts(carts.left_carts(events))


@query("x3_left_carts_stream", ("m_events",), "WITH " + LEFT.format(where="event_id % 50 <> 0") + "SELECT * FROM a WHERE last_cart + INTERVAL 20 MINUTE <= (SELECT max(make_timestamp(us // 1000 * 1000)) FROM s)")
def _(events):
    """All events of a folder through the stateful form: alerts of runs whose end the watermark has passed."""
    spark = events.sparkSession
    src, base = _event_files(events)
    alerts = carts.left_carts_stream(event_sources.file_events(spark, src, ALL))
    sinks.start_sink(alerts, "left-carts", "append", "parquet", f"{base}/checkpoint", f"{base}/rows", available_now=True, rocksdb=True).awaitTermination()
    return _alerts(spark.read.parquet(f"{base}/rows"))


@query("x4_funnel_updates", ("m_events",), f"SELECT *, round(purchase * 100.0::DOUBLE / nullif(page_view, 0), 2) AS conversion_pct, window_start + INTERVAL 1 MINUTE AS window_end FROM (SELECT {FUNNEL}, date_trunc('minute', event_timestamp) AS window_start FROM m_events WHERE event_id % 50 <> 0 GROUP BY date_trunc('minute', event_timestamp))")
def _(events):
    """The funnel in update mode, without sets: what was written last of each window, open ones included."""
    spark = events.sparkSession
    src, base = _event_files(events)
    funnel = stream.live_funnel(event_sources.file_events(spark, src, ALL), chained=False)
    sinks.start_upsert(funnel, "funnel-updates", ["window_start", "window_end"], f"{base}/rows", f"{base}/checkpoint", available_now=True).awaitTermination()
    return sinks.latest(spark, f"{base}/rows", ["window_start", "window_end"])


@query("x1_session_updates", ("m_events",), "SELECT device_type, count(DISTINCT session_id) AS sessions, count(*) AS events, count(DISTINCT customer_id) AS users, date_trunc('minute', event_timestamp) AS window_start FROM m_events WHERE event_id % 50 <> 0 GROUP BY ALL")
def _(events):
    spark = events.sparkSession
    src, base = _event_files(events)
    counts = stream.session_agg(event_sources.file_events(spark, src, ALL), form="rows")
    sinks.start_upsert(counts, "session-updates", ["window_start", "device_type"], f"{base}/rows", f"{base}/checkpoint", available_now=True).awaitTermination()
    return sinks.latest(spark, f"{base}/rows", ["window_start", "device_type"]).select("device_type", "sessions", "events", "users", "window_start")


@query("q1_stream_deduplication", ("m_events",), """WITH e AS (SELECT event_id, session_id, event_type, event_timestamp, 1 AS part FROM m_events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, session_id, 'search', event_timestamp, 2 FROM m_events WHERE event_id % 2 = 0)
SELECT CAST(event_id AS VARCHAR) AS event_id, session_id, event_type, event_timestamp FROM e WHERE event_id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY part) = 1""")
def _(events):
    """Two thirds of the events, then, after a restart, half of all events under another type: ids that came before are dropped."""
    spark = events.sparkSession
    src, base = _event_files(events.filter("event_id % 3 <> 0"))
    run = lambda: sinks.start_sink(clean_click_stream(event_sources.file_events(spark, src, ALL)), "clicks-once", "append", "parquet", f"{base}/checkpoint", f"{base}/rows", available_now=True).awaitTermination()
    run()
    _event_files(events.filter("event_id % 2 = 0").withColumn("event_type", F.lit(" Search")), more_in=src)
    run()
    return spark.read.parquet(f"{base}/rows").select("event_id", "session_id", "event_type", "event_timestamp")


def _again(name: str) -> str:
    """The SQL of another query, which defines its model tables itself."""
    return f"SELECT * FROM ({ORACLE_SQL[name]})"


# ---- loads and merges over several runs ---------------------------------------


@query("s4_load_ledger", ("m_orders",), """WITH o AS (SELECT order_id, order_id % 4 AS part, order_id % 31 = 0 OR order_id % 4 = 3 AS bad FROM m_orders), c AS (SELECT part, count(*) FILTER (NOT bad) AS rows, count(*) FILTER (bad) AS errors FROM o GROUP BY part),
l AS (SELECT part, CASE WHEN part < 2 THEN 0 ELSE 1 END AS load FROM c UNION ALL SELECT part, 2 FROM c)
SELECT CAST(part AS BIGINT) AS part, CAST(load AS BIGINT) AS load, rows, errors, CASE WHEN errors = 0 THEN 'LOADED' WHEN rows = 0 THEN 'LOAD_FAILED' ELSE 'PARTIALLY_LOADED' END AS status, load = 2 AS counts FROM l JOIN c USING (part)""")
def _(orders):
    """Two loads of two files each, one that finds nothing, and one that is forced and replaces all: a ledger row for each file and load."""
    spark = orders.sparkSession
    src, dst = new_path(spark, "incoming"), new_path(spark, "ledgered")
    i = F.col("order_id")
    rows = orders.select((i % 4).alias("part"), F.when((i % 31 == 0) | (i % 4 == 3), F.lit("broken")).otherwise(i.cast("string")).alias("order_id"), "customer_id")
    for pair in ((0, 1), (2, 3)):
        for part in pair:
            rows.filter(F.col("part") == part).drop("part").coalesce(1).write.option("header", True).csv(f"{src}/part{part}")
        ledger.load_files(spark, f"{src}/part*", "order_id long, customer_id long", dst)
    ledger.load_files(spark, f"{src}/part*", "order_id long, customer_id long", dst)
    ledger.load_files(spark, f"{src}/part*", "order_id long, customer_id long", dst, force=True)
    counted = ledger.loaded_rows(spark, dst).select("load").distinct().withColumn("counts", F.lit(True))
    part = F.regexp_extract("file", "part([0-9])/", 1).cast("long")
    return ledger.read_ledger(spark, dst).join(counted, "load", "left").select(part.alias("part"), "load", "rows", "errors", "status", F.coalesce("counts", F.lit(False)).alias("counts"))


@query("w12_keys_over_two_loads", ("m_customers",), """WITH a AS (SELECT DISTINCT country, city FROM m_customers WHERE customer_id % 3 = 0 AND city > 'F'), k AS (SELECT country, city, row_number() OVER (ORDER BY country || chr(31) || city) AS sk FROM a),
n AS (SELECT DISTINCT country, city FROM m_customers WHERE city < 'M' EXCEPT SELECT country, city FROM a)
SELECT country, city, sk AS geo_sk FROM k UNION ALL SELECT country, city, row_number() OVER (ORDER BY country || chr(31) || city) + (SELECT max(sk) FROM k) FROM n""")
def _(customers):
    """Cities of one load and then of another that lacks some of them: the first keep their keys, new ones come above."""
    first = warehouse.build_dim(customers.filter("customer_id % 3 = 0 and city > 'F'"), ["country", "city"], "geo_sk")
    both = warehouse.build_dim(customers.filter("city < 'M'"), ["country", "city"], "geo_sk", first)
    return both.select("country", "city", F.col("geo_sk").cast("long").alias("geo_sk"))


CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("w5_conversion_rate", ("m_orders", "m_customers", "m_events"), f"""WITH v AS (SELECT DISTINCT CAST(event_date - INTERVAL 26 YEAR AS DATE) AS order_date, [{", ".join(f"'{c}'" for c in CHANNELS)}][m_events.customer_id % 5 + 1] AS channel, country, session_id FROM m_events JOIN m_customers USING (customer_id)),
s AS (SELECT order_date, channel, country, count(*) AS sessions FROM v GROUP BY ALL), o AS (SELECT order_date, channel, country, count(*) AS orders FROM m_orders JOIN m_customers USING (customer_id) GROUP BY ALL)
SELECT order_date, channel, country, orders, round(orders::DOUBLE * 100 / sessions, 2) AS conversion_rate FROM o LEFT JOIN s USING (order_date, channel, country)""")
def _(orders, customers, events):
    """Orders per 100 sessions; events are moved 26 years back, to days that have orders, and their customers to the orders' channels."""
    channel = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("customer_id") % 5 + 1).cast("int"))
    visits = events.select(F.add_months("event_date", -26 * 12).alias("event_date"), channel.alias("channel"), "customer_id", "session_id")
    return warehouse.agg_daily_revenue(orders, customers, visits).select("order_date", "channel", "country", "orders", "conversion_rate")


@query("w2_merge_into_slices", ("m_customers",), _again("w2_scd2_customer"))
def _(customers):
    """The merge of a stored dimension, run twice on one day; slices of closed versions are only added to."""
    spark, i = customers.sparkSession, F.col("customer_id")
    old = customers.filter(i % 10 != 0).select(i, "city", "segment", F.lit("2000-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    new = customers.filter(i % 7 != 0).select(i, F.when(i % 4 == 0, "moved").otherwise(F.col("city")).alias("city"), F.when(i % 6 != 0, F.col("segment")).alias("segment"))
    scd.store_slices(old, path := new_path(spark, "dim-customer"))
    for _ in range(2):
        scd.scd2_merge_into(spark, path, new, "customer_id", ["city", "segment"], AS_OF)
    return scd.read_slices(spark, path).select("customer_id", "city", "segment", "start_date", "end_date", "is_current")


@query("w4_load_against_history", ("m_orders", "m_items", "m_customers"), """WITH c AS (SELECT order_id, count(*) n FROM m_items GROUP BY 1)
SELECT order_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_key, customer_id, status, coalesce(n, 0) AS item_count FROM m_orders JOIN m_customers USING (customer_id) LEFT JOIN c USING (order_id) WHERE order_date >= DATE '2001-01-01' AND order_id % 3 <> 0""")
def _(orders, items, customers):
    """A batch of the last months, a third of which is stored already, against a history in slices by month: only the batch's months are read."""
    spark = orders.sparkSession
    done = orders.filter("order_date < '2001-01-01' or order_id % 3 = 0").select("order_id", F.floor(date_key(F.col("order_date")) / 100).cast("int").alias("order_month"))
    done.repartition("order_month").write.partitionBy("order_month").parquet(path := new_path(spark, "fact-orders"))
    dim = customers.select("customer_id", F.col("customer_id").alias("customer_sk"), "country", "city", F.lit(True).alias("is_current"))
    channels, geo = warehouse.build_dim(orders, ["channel"], "channel_sk"), customers.select("country", "city", F.col("customer_id").alias("geo_sk"))
    fact = warehouse.load_fact_orders(orders.filter("order_date >= '2001-01-01'"), items, dim, channels, geo, spark.read.parquet(path))
    return fact.select("order_id", "order_date_key", "customer_id", "status", "item_count")


@query("w13_as_of_join_in_stretches", ("m_orders", "m_customers"), _again("w13_as_of_join"))
def _(orders, customers):
    early = customers.select("customer_id", F.lit("early").alias("country"), F.lit("1900-01-01").cast("date").alias("start_date"), F.lit("1998-01-01").cast("date").alias("end_date"))
    late = customers.select("customer_id", "country", F.lit("1998-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return scd.as_of_join(orders.select("order_id", "customer_id", "order_date"), early.unionByName(late), "customer_id", "order_date", "inner", bucket_days=90).select("order_id", "country")
