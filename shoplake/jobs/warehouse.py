"""Dimensions, facts and marts of the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.functions.cluster import broadcast_if_small
from shoplake.functions.expr import age_group_by_year, as_date, date_key, full_name, gross_margin_pct, pct
from shoplake.operators.quality import dedupe_keep_first
from shoplake.operators.scd import scd2_merge, surrogate_keys


def date_dim(spark: SparkSession, start: str = "2020-01-01", days: int = 1825) -> DataFrame:
    """``days`` days from ``start``: the default ends on 2024-12-29, so derive the range from the data where that matters."""
    last = dt.date.fromisoformat(start) + dt.timedelta(days=days - 1)
    d = F.col("full_date")
    rows = spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(last))).alias("full_date"))
    weekday = F.dayofweek(d) - 1
    return rows.select(
        date_key(d).alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMM").alias("month_name"), F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"), weekday.alias("weekday"), F.date_format(d, "EEE").alias("day_name"), weekday.isin(0, 6).alias("is_weekend"), F.year(d).alias("fiscal_year"), F.quarter(d).alias("fiscal_quarter"), F.month(d).alias("fiscal_month"),
    )


def _recent(stage: DataFrame, loaded_at: str | None, hours: int = 25) -> DataFrame:
    """Rows loaded within ``hours`` before ``loaded_at``; all if it isn't given."""
    if loaded_at is None or "_load_timestamp" not in stage.columns:
        return stage
    return stage.filter(F.col("_load_timestamp") >= F.lit(loaded_at).cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def scd2_customer(current: DataFrame, stage: DataFrame, as_of, loaded_at: str | None = None) -> DataFrame:
    """Versions change with email, city or segment."""
    src = _recent(stage, loaded_at).select("customer_id", full_name(F.col("first_name"), F.col("last_name")).alias("full_name"), "email", "city", "country", "segment", age_group_by_year(F.col("date_of_birth"), as_of).alias("age_group"))
    return scd2_merge(current, src, "customer_id", ["email", "city", "segment"], as_of)


def scd2_product(current: DataFrame, stage: DataFrame, categories: DataFrame, as_of, loaded_at: str | None = None) -> DataFrame:
    """Versions change with unit price or activity; ``categories``: (category_name, category_sk)."""
    src = _recent(stage, loaded_at).join(broadcast_if_small(categories, 1_000_000), "category_name", "left")
    src = src.select("product_id", "product_name", "category_sk", "brand", "unit_price", "cost_price", gross_margin_pct(F.col("unit_price"), F.col("cost_price")).alias("margin_pct"), "is_active")
    return scd2_merge(current, src, "product_id", ["unit_price", "is_active"], as_of)


def build_dim(stage: DataFrame, columns: list[str], sk: str, existing: DataFrame | None = None) -> DataFrame:
    """Distinct values of stage columns (category, channel, geography, payment method) under dense keys; rows whose first column is null have none.

    Members of ``existing`` (columns, sk) stay, with their keys, whether or not
    they come again; new ones get keys above. Values of several columns are one
    natural key, in which a null is a value of its own.
    """
    natural = F.col(columns[0]) if len(columns) == 1 else F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns])
    rows = stage.select(*columns).filter(F.col(columns[0]).isNotNull())
    known = existing.select(natural.alias("_natural"), sk) if existing is not None else None
    rows = rows.unionByName(existing.select(*columns)) if existing is not None else rows
    return surrogate_keys(rows.distinct().withColumn("_natural", natural), "_natural", known, sk).drop("_natural")


def unseen(batch: DataFrame, existing: DataFrame, key: str, slice_by: str | None = None, small: int = 5_000_000) -> DataFrame:
    """Rows of ``batch`` whose ``key`` is not null and not in ``existing``, a history that may be far larger.

    Keys of a batch of at most ``small`` rows go to the history, so that the
    history isn't shuffled, and what they find comes back. With ``slice_by``, a column of both by which
    the history is stored, a day for instance, only slices that the batch has are read; a key then counts as
    seen if it is in one of those.
    """
    rows = batch.filter(F.col(key).isNotNull())
    if slice_by:
        found = [r[0] for r in rows.select(slice_by).distinct().limit(10_001).collect()]  # with more slices than that, all are read and the join tells
        if len(found) <= 10_000:
            existing = existing.filter(F.col(slice_by).isin([x for x in found if x is not None]))
    seen = existing.select(key).join(broadcast_if_small(rows.select(key).distinct(), small), key, "left_semi")
    return rows.join(seen, key, "left_anti")


def load_fact_orders(orders: DataFrame, items: DataFrame, customers: DataFrame, channels: DataFrame, geography: DataFrame, existing: DataFrame) -> DataFrame:
    """New orders only; ``existing`` (order_id) may have order_date_key or order_month (yyyymm), and is then read for the days or months of ``orders`` alone. ``customers``: dimension with customer_sk, city, country and is_current; ``channels``: (channel, channel_sk); ``geography``: (country, city, geo_sk).

    Orders are unique before items are counted, one geography row stands for a
    city, and items are aggregated before the join.
    """
    fresh = dedupe_keep_first(orders.filter("order_id is not null"), ["order_id"], [F.col(c).cast("string") for c in orders.columns])
    slices = {"order_date_key": date_key(F.col("order_date")), "order_month": F.floor(date_key(F.col("order_date")) / 100).cast("int")}
    slice_by = next((c for c in slices if c in existing.columns), None)
    fresh = unseen(fresh.withColumn(slice_by, slices[slice_by]) if slice_by else fresh, existing, "order_id", slice_by)
    counts = items.groupBy("order_id").agg(F.count("*").alias("item_count"))
    who = customers.filter("is_current").select("customer_id", "customer_sk", "country", "city")
    geo = geography.groupBy("country", "city").agg(F.min("geo_sk").alias("geo_sk"))
    rows = fresh.join(who, "customer_id").join(channels, "channel", "left").join(geo, ["country", "city"], "left").join(counts, "order_id", "left")
    return rows.select("order_id", date_key(F.col("order_date")).alias("order_date_key"), "customer_sk", "customer_id", "channel_sk", "geo_sk", "status", F.coalesce("item_count", F.lit(0)).alias("item_count"), "total_amount", "discount_amount", "tax_amount", "shipping_cost", (F.col("total_amount") - F.col("discount_amount") - F.col("shipping_cost")).alias("net_revenue"))


def load_fact_items(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """``products``: (product_id, product_sk, cost_price). line_margin = line_total - quantity * cost_price."""
    rows = items.join(orders.select("order_id", "order_date"), "order_id").join(products, "product_id", "left")
    cost = F.col("quantity") * F.col("cost_price")
    return rows.select("order_id", "product_id", "product_sk", date_key(F.col("order_date")).alias("order_date_key"), "quantity", F.col("line_total").alias("line_revenue"), cost.alias("line_cost"), (F.col("line_total") - cost).alias("line_margin"))


def load_fact(stage: DataFrame, date_column: str, key_name: str, dims: list[tuple[DataFrame, str]], existing: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Payments, clickstream and reviews: a date key and left joins to dimension keys; ``existing`` rows by ``key`` are skipped, read for the days of ``stage`` alone if they have ``key_name``."""
    rows = stage.withColumn(key_name, date_key(F.col(date_column)))
    if existing is not None:
        rows = unseen(rows, existing, key, key_name if key_name in existing.columns else None)
    for dim, on in dims:
        rows = rows.join(dim, on, "left")
    return rows


def agg_daily_revenue(orders: DataFrame, customers: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """By date, channel and country, with customers registered that day and before.

    ``conversion_rate`` is orders per 100 sessions of the day, channel and country, from ``events`` (event_date,
    channel, customer_id, session_id); null without them or where there is no session.
    """
    rows = orders.join(customers.select("customer_id", "country", "registration_date"), "customer_id")
    new, old = F.col("registration_date") == F.col("order_date"), F.col("registration_date") < F.col("order_date")
    keys = ["order_date", "channel", "country"]
    per = rows.groupBy(*keys, "customer_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("total_amount", "discount_amount", "tax_amount", "net_revenue")], F.max(new.cast("int")).alias("new"), F.max(old.cast("int")).alias("old"))
    d = lambda c: F.sum(c).cast("double")
    out = per.groupBy(*keys).agg(F.sum("n").alias("orders"), d("total_amount").alias("gross"), d("discount_amount").alias("discount"), d("tax_amount").alias("tax"), d("net_revenue").alias("net"), F.sum(F.coalesce("new", F.lit(0))).alias("new_customers"), F.sum(F.coalesce("old", F.lit(0))).alias("returning_customers"))
    out = out.withColumn("aov", F.col("net") / F.col("orders"))
    if events is None:
        return out.withColumn("conversion_rate", F.lit(None).cast("double"))
    # Sessions first, then their number, so that a busy day is dealt out.
    visits = events.filter("session_id is not null").select(F.col("event_date").alias("order_date"), "channel", "customer_id", "session_id").join(customers.select("customer_id", "country"), "customer_id")
    sessions = visits.select(*keys, "session_id").distinct().groupBy(*keys).agg(F.count("*").alias("_sessions"))
    return out.join(sessions, keys, "left").withColumn("conversion_rate", pct(F.col("orders").cast("double"), F.col("_sessions"))).drop("_sessions")


def agg_product_monthly(items: DataFrame, orders: DataFrame, products: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Per product and month: sales, margin, ratings, return rate, views and conversion, each source aggregated before they join."""
    month = lambda c: F.trunc(c, "month").cast("date")
    lines = items.join(orders.select("order_id", "order_date", "status"), "order_id").join(products.select("product_id", "cost_price"), "product_id")
    returned = F.col("status").isin("REFUNDED", "CANCELLED")
    sold = lines.groupBy("product_id", month("order_date").alias("month")).agg(F.sum("quantity").alias("units"), F.sum("line_total").alias("rev"), F.sum(F.col("quantity") * F.col("cost_price")).alias("cost"), F.sum(F.when(returned, F.col("quantity")).otherwise(0)).alias("back"))
    rated = reviews.groupBy("product_id", month("review_date").alias("month")).agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("reviews"))
    seen = events.filter("product_id is not null").groupBy(F.col("product_id").cast("long").alias("product_id"), month("event_date").alias("month")).agg(*[F.sum((F.col("event_type") == e).cast("long")).alias(a) for e, a in (("product_view", "page_views"), ("add_to_cart", "carts"), ("purchase", "bought"))])
    rows = sold.join(rated, ["product_id", "month"], "full_outer").join(seen, ["product_id", "month"], "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    d = lambda c: F.col(c).cast("double")
    return rows.select("product_id", "month", z("units").alias("units"), d("rev").alias("revenue"), d("cost").alias("cost"), (d("rev") - d("cost")).alias("margin"), ((d("rev") - d("cost")) * 100 / F.nullif(d("rev"), F.lit(0.0))).alias("margin_pct"), "avg_rating", z("reviews").alias("reviews"), F.try_divide(z("back") * 100.0, F.nullif(F.col("units"), F.lit(0).cast("long"))).alias("return_rate"), z("page_views").alias("page_views"), z("carts").alias("add_to_carts"), F.try_divide(z("bought") * 100.0, F.nullif(F.col("page_views"), F.lit(0).cast("long"))).alias("conversion"))


def agg_customer_rfm(rfm: DataFrame, clv: DataFrame, customers: DataFrame) -> DataFrame:
    return rfm.join(clv.select("customer_id", F.col("clv_365d").alias("predicted_clv")), "customer_id", "left").join(customers.select("customer_id", "full_name", "city", "country", F.col("segment").alias("market_segment")), "customer_id", "left")


def agg_clv(clv: DataFrame) -> DataFrame:
    return clv.select("customer_id", "frequency", "revenue", "aov", "lifespan_days", "clv_90d", "clv_365d", "tier")


__all__ = ["agg_clv", "agg_customer_rfm", "agg_daily_revenue", "agg_product_monthly", "build_dim", "date_dim", "load_fact", "load_fact_items", "load_fact_orders", "pct", "scd2_customer", "scd2_product", "unseen"]
