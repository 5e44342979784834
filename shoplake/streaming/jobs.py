"""Clickstream jobs: functions of an events DataFrame, valid on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "event_timestamp"


def _watermark(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark(TS, delay) if events.isStreaming else events


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def _again(df: DataFrame, window: str, slide: str | None = None) -> Column:
    """The window of rows that have a window already: the same one, or the longer ones that it lies in."""
    at = F.window_time("window") if df.isStreaming else F.expr("window.end - interval 1 microsecond")
    return F.window(at, window, slide) if slide else F.window(at, window)


def _distinct(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``; a stream's state is a row for each that the watermark hasn't passed."""
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def session_agg(events: DataFrame, window: str = "1 minute", delay: str = "2 minutes", form: str = "chained") -> DataFrame:
    """Distinct sessions, events and distinct users per window and device.

    ``chained`` counts events for each session and user first, so no task and no
    state holds a set (streams: append mode only). ``rows`` drops repeated sessions,
    users and event_ids from the stream instead and runs in every mode; an event
    that comes twice counts once. ``approximate`` keeps sketches.
    """
    rows = _watermark(events, delay)
    if form == "approximate":
        count = F.approx_count_distinct
        return _flat(rows.groupBy(F.window(TS, window), "device_type").agg(count("session_id").alias("sessions"), F.count("*").alias("events"), count("customer_id").alias("users")))
    mark = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    marks = [mark("sessions", "session_id"), mark("users", "customer_id")]
    seen = lambda kind, value=F.lit(1): F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("id").isNotNull(), value)), F.lit(0)).cast("long")
    if form == "rows":
        each = rows.select(TS, "device_type", F.window(TS, window)["start"].alias("starts"), F.explode(F.array(*marks, mark("events", "event_id"))).alias("m")).select(TS, "device_type", "starts", "m.*")
        out = _distinct(each, ["starts", "device_type", "kind", "id"]).groupBy(F.window(TS, window), "device_type").agg(seen("sessions").alias("sessions"), seen("events").alias("events"), seen("users").alias("users"))
        return _flat(out)
    each = rows.select(TS, "device_type", F.explode(F.array(*marks)).alias("m")).select(TS, "device_type", "m.*")
    parts = each.groupBy(F.window(TS, window), "device_type", "kind", "id").agg(F.count("*").alias("n"))
    out = parts.groupBy(_again(parts, window).alias("window"), "device_type").agg(seen("sessions").alias("sessions"), F.sum(F.when(F.col("kind") == "sessions", F.col("n"))).alias("events"), seen("users").alias("users"))
    return _flat(out)


def trending_products(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Counts and scores per sliding window, product and kind, from panes of one slide each: events are grouped once and only panes go into several windows."""
    kind = F.col("event_type")
    rows = _watermark(events, delay).filter(kind.isin("product_view", "add_to_cart", "purchase") & F.col("product_id").isNotNull() & (F.col("product_id").cast("string") != ""))
    panes = rows.groupBy(F.window(TS, slide), "product_id", "event_type").agg(F.count("*").alias("n"))
    out = panes.groupBy(_again(panes, window, slide).alias("window"), "product_id", "event_type").agg(F.sum("n").alias("n"))
    return _flat(out.withColumn("score", F.col("n") * F.when(kind == "purchase", 10).when(kind == "add_to_cart", 3).otherwise(1)))


def cart_abandonment(events: DataFrame, window: str = "10 minutes", slide: str = "2 minutes", delay: str = "10 minutes") -> DataFrame:
    """Windows of a session with a cart and no purchase, from panes of one slide each; a session can alert in each overlapping window (``carts.left_carts`` alerts once)."""
    hit = lambda e: F.sum(F.when(F.col("event_type") == e, 1).otherwise(0))
    cart = F.when(F.col("event_type") == "add_to_cart", F.col("product_id"))
    panes = _watermark(events, delay).groupBy(F.window(TS, slide), "session_id", "customer_id").agg(hit("add_to_cart").alias("carts"), hit("purchase").alias("purchases"), F.collect_set(cart).alias("products"))
    out = panes.groupBy(_again(panes, window, slide).alias("window"), "session_id", "customer_id").agg(F.sum("carts").alias("carts"), F.sum("purchases").alias("purchases"), F.array_distinct(F.flatten(F.collect_list("products"))).alias("products"))
    return _flat(out.filter("carts > 0 and purchases = 0").withColumn("abandonment_flag", F.lit(True)))


STEPS = ("page_view", "product_view", "add_to_cart", "checkout", "purchase")


def _conversion(df: DataFrame) -> DataFrame:
    rate: Column = F.round(F.try_divide(F.col("purchase") * 100.0, F.nullif(F.col("page_view"), F.lit(0).cast("long"))), 2)
    return df.withColumn("conversion_pct", rate)


def live_funnel(events: DataFrame, window: str = "1 minute", delay: str = "1 minute", chained: bool = True) -> DataFrame:
    """Distinct sessions per step and window.

    ``chained`` sums per-session flags, so no task holds a whole window's
    sessions (streams: append mode only). The other form drops repeated sessions of
    a step from the stream and runs in every mode.
    """
    rows = _watermark(events, delay).filter("session_id is not null")
    if chained:
        flags = rows.groupBy(F.window(TS, window), "session_id").agg(*[F.max(F.when(F.col("event_type") == s, 1).otherwise(0)).alias(s) for s in STEPS])
        out = flags.groupBy(_again(flags, window).alias("window")).agg(*[F.sum(s).cast("long").alias(s) for s in STEPS])
    else:
        each = _distinct(rows.select(TS, F.window(TS, window)["start"].alias("starts"), "event_type", "session_id"), ["starts", "event_type", "session_id"])
        out = each.groupBy(F.window(TS, window)).agg(*[F.sum(F.when(F.col("event_type") == s, 1).otherwise(0)).cast("long").alias(s) for s in STEPS])
    return _flat(_conversion(out))


def first_events(events: DataFrame, keys: tuple[str, ...] = ("event_id",), delay: str | None = None) -> DataFrame:
    """Events of which each key comes once, the one seen first.

    A stream remembers keys in its checkpoint, over batches and restarts: all of them, or with ``delay`` those that the
    watermark hasn't passed. Of equal keys within one batch any is the first. Null keys are equal.
    """
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(TS, delay).dropDuplicatesWithinWatermark(list(keys)) if delay else events.dropDuplicates(list(keys))


def velocity_anomaly(events: DataFrame, threshold: int = 200, window: str = "5 minutes", delay: str = "5 minutes") -> DataFrame:
    out = _watermark(events, delay).groupBy(F.window(TS, window), "session_id", "customer_id").agg(F.count("*").alias("n"))
    return _flat(out.filter(F.col("n") > threshold).withColumn("alert", F.lit("HIGH_VELOCITY")))


JOBS = {"session_agg": session_agg, "trending_products": trending_products, "cart_abandonment": cart_abandonment, "live_funnel": live_funnel, "velocity_anomaly": velocity_anomaly}
