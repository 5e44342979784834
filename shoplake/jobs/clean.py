"""Cleaning of the six raw tables: each job returns (clean rows, report row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shoplake.functions import expr as E
from shoplake.operators.quality import Rule, apply_rules, dedupe_keep_first
from shoplake.streaming.jobs import first_events


def _order(df: DataFrame) -> list[Column]:
    """File order where it is known, else all columns, so that "first" is defined."""
    return [F.col("_row_number")] if "_row_number" in df.columns else [F.col(c).cast("string") for c in df.columns]


def clean_customers(raw: DataFrame, as_of, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    day = E.as_date(as_of)
    df = raw.withColumns({"registration_date": E.to_date_or_null(F.substring(F.col("registration_date").cast("string"), 1, 10)), "date_of_birth": E.to_date_or_null(F.substring(F.col("date_of_birth").cast("string"), 1, 10))})
    rules = [
        Rule("null_email", F.col("email").isNull(), quiet=True), Rule("invalid_email_format", ~E.valid_email(F.col("email"))),
        Rule("future_registration_date", F.col("registration_date") > day, quiet=True), Rule("dob_too_young", F.datediff(day, "date_of_birth") < 365 * 16, quiet=True),
    ]
    good, report = apply_rules(df, "customers", rules, ("duplicate_customer_id", ["customer_id"], _order(raw)), seen=seen)
    out = good.withColumns({
        "email": E.strip_lower(F.col("email")), "first_name": E.strip_title(F.col("first_name")), "last_name": E.strip_title(F.col("last_name")), "gender": E.strip_lower(F.col("gender")),
        "country": E.strip_upper(F.col("country")), "segment": E.fill(F.col("segment"), "Unknown"), "age": E.age(F.col("date_of_birth"), as_of),
    })
    return out.withColumn("age_group", E.age_group(F.col("age"))), report


def clean_products(raw: DataFrame, strict_report: bool = False, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    price, cost = F.col("unit_price"), F.col("cost_price")
    df = raw.withColumns({"unit_price": price.try_cast("double"), "cost_price": cost.try_cast("double")})
    fixed = E.repair_cost(cost, price)
    rules = [Rule("non_positive_unit_price", price <= 0), Rule("negative_cost_price", cost < 0, drops=False), Rule("inverted_margin", E.gross_margin_pct(price, fixed) < 0, drops=False)]
    good, report = apply_rules(df, "products", rules, ("duplicate_product_id", ["product_id"], _order(raw)), strict_report, seen)
    good = good.withColumn("cost_price", fixed)
    return good.withColumns({"gross_margin_pct": E.gross_margin_pct(price, cost), "brand": E.strip_title(F.col("brand")), "product_name": E.strip(F.col("product_name")), "is_active": E.truthy(F.col("is_active"))}), report


def clean_orders(raw: DataFrame, items: DataFrame, strict_report: bool = False, seen: Observation | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, items, report of orders)."""
    numbers = {c: E.to_number_or(F.col(c), "double", 0.0) for c in ("total_amount", "discount_amount", "tax_amount", "shipping_cost")}
    df = raw.withColumns({"order_date": E.to_ts_or_null(F.col("order_date")), **numbers})
    rules = [Rule("negative_total_amount", F.col("total_amount") < 0), Rule("invalid_status", ~F.coalesce(F.col("status").isin(list(E.ORDER_STATUS)), F.lit(False)), drops=False)]
    good, report = apply_rules(df, "orders", rules, ("duplicate_order_id", ["order_id"], _order(raw)), strict_report, seen)
    orders = good.withColumns({
        "status": E.in_domain_or(F.col("status"), E.ORDER_STATUS, "PENDING"), "channel": E.fill(F.col("channel"), "web"), "currency": F.upper(E.fill(F.col("currency"), "USD")),
        "net_revenue": E.net_revenue(F.col("total_amount"), F.col("discount_amount"), F.col("shipping_cost")),
    })
    lines = items.withColumns({"quantity": E.to_number_or(F.col("quantity"), "int", 1), **{c: E.to_number_or(F.col(c), "double", 0.0) for c in ("unit_price", "discount_pct", "line_total")}})
    lines = lines.withColumn("line_total_check", E.line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct")))
    return orders, lines, report


def line_total_mismatch(items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return items.agg(F.coalesce(F.sum((F.abs(F.col("line_total") - F.col("line_total_check")) > tolerance).cast("long")), F.lit(0)).alias("line_total_mismatch"))


def clean_payments(raw: DataFrame, strict_report: bool = False, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    df = raw.withColumns({"payment_date": E.to_ts_or_null(F.col("payment_date")), "amount": F.col("amount").try_cast("double")})
    good, report = apply_rules(df, "payments", [Rule("null_amount", F.col("amount").isNull())], ("duplicate_payment_id", ["payment_id"], _order(raw)), strict_report, seen)
    return good.withColumn("payment_method", E.in_domain_or(E.strip_lower(F.col("payment_method")), E.PAYMENT_METHODS, "other")), report


def clean_reviews(raw: DataFrame, strict_report: bool = False, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    df = raw.withColumn("rating", F.col("rating").try_cast("double"))
    good, report = apply_rules(df, "reviews", [Rule("invalid_rating", ~F.coalesce(F.col("rating").between(1, 5), F.lit(False)))], ("duplicate_review", ["customer_id", "product_id", "review_date"], _order(raw)), strict_report, seen)
    return good.withColumns({
        "rating": F.col("rating").cast("int"), "review_date": E.to_date_or_null(F.col("review_date")), "helpful_votes": E.to_number_or(F.col("helpful_votes"), "int", 0), "verified_purchase": E.truthy(F.col("verified_purchase")),
        "review_body": E.truncate(E.strip(F.col("review_body")), 4000), "review_title": E.truncate(E.strip(F.col("review_title")), 500), "sentiment": E.sentiment(F.col("rating").cast("int")),
    }), report


def clean_clickstream(raw: DataFrame, strict_report: bool = False, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    df = raw.withColumn("event_timestamp", E.to_ts_or_null(F.col("event_timestamp")))
    good, report = apply_rules(df, "clickstream", [Rule("null_timestamp", F.col("event_timestamp").isNull())], ("duplicate_event_id", ["event_id"], _order(raw)), strict_report, seen)
    return _clicks(good), report


def _clicks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"event_type": E.in_domain_or(E.strip_lower(F.col("event_type")), E.EVENT_TYPES, "other"), "device_type": E.strip_lower(F.col("device_type")), "customer_id": E.empty_to_null(F.col("customer_id"))})


def clean_click_stream(raw: DataFrame, delay: str | None = None) -> DataFrame:
    """``clean_clickstream`` of a stream: an event_id counts once over all batches and restarts (``delay``: as long as the watermark goes back)."""
    df = raw.withColumn("event_timestamp", E.to_ts_or_null(F.col("event_timestamp"))).filter("event_timestamp is not null")
    return _clicks(first_events(df, ("event_id",), delay))


def run_etl(raw: dict[str, DataFrame], as_of, path: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables by name; missing ones are skipped. Returns clean tables and one report row for each.

    With ``path`` the tables are written below it and read back from there, and the
    counts of the report are observed in those writes, so a raw table is read and
    sorted once. Without it, rows and report are plans of their own.
    """
    if not raw.keys() & {"customers", "products", "payments", "reviews", "clickstream"} and not raw.keys() >= {"orders", "order_items"}:
        raise ValueError("no raw table given")
    found, reports = {}, []
    jobs = {
        "orders": lambda d, s: clean_orders(d, raw["order_items"], seen=s), "customers": lambda d, s: clean_customers(d, as_of, s), "products": lambda d, s: clean_products(d, seen=s),
        "payments": lambda d, s: clean_payments(d, seen=s), "reviews": lambda d, s: clean_reviews(d, seen=s), "clickstream": lambda d, s: clean_clickstream(d, seen=s),
    }
    for name, job in jobs.items():
        if name not in raw or (name == "orders" and "order_items" not in raw):
            continue
        rows, *more, report = job(raw[name], Observation(name) if path else None)
        found[name] = rows
        if more:
            found["order_items"] = more[0]
        if path:
            for table in [name, *["order_items"] * len(more)]:
                found[table].write.mode("overwrite").parquet(f"{path}/{table}")
                found[table] = rows.sparkSession.read.schema(found[table].schema).parquet(f"{path}/{table}")
            report = report()
        reports.append(report)
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return found, report


__all__ = ["clean_click_stream", "clean_clickstream", "clean_customers", "clean_orders", "clean_payments", "clean_products", "clean_reviews", "dedupe_keep_first", "line_total_mismatch", "run_etl"]
