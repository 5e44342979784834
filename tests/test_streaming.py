import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from shoplake.sources.events import file_events, parse_kafka_value
from shoplake.sources.fixtures import model
from shoplake.jobs.clean import clean_click_stream
from shoplake.streaming import carts, jobs, sinks

DELAY = {"session_agg": 2, "trending_products": 5, "cart_abandonment": 10, "live_funnel": 1, "velocity_anomaly": 5}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "rows")
    rows = model(spark, "/root/testdata/sf0.001", "m_events").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    # Files are taken by their time of writing, so one after another in time order; rows in any order inside them.
    days = [r.d for r in rows.select(F.to_date("event_timestamp").alias("d")).distinct().orderBy("d").collect()]
    for lo in range(0, len(days), 12):
        part = days[lo : lo + 12]
        rows.filter(F.to_date("event_timestamp").between(part[0], part[-1])).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def collected(df):
    cols = sorted(df.columns)
    return sorted(str(tuple(sorted(v) if isinstance(v, list) else v for v in r)) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(jobs.JOBS))
def test_stream_equals_batch(spark, folder, name, tmp_path):
    batch = spark.read.parquet(folder)
    job = (lambda d: jobs.velocity_anomaly(d, threshold=1)) if name == "velocity_anomaly" else jobs.JOBS[name]
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    for _ in range(2):  # the second start finds nothing new: no duplicates
        q = sinks.start_sink(job(stream), f"t_{name}", "append", "parquet", str(tmp_path / "ck"), str(tmp_path / "out"), available_now=True)
        q.awaitTermination(120)
    last = batch.agg(F.max("event_timestamp")).first()[0] - dt.timedelta(minutes=DELAY[name])
    want = job(batch).filter(F.col("window_end") <= F.lit(last))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert collected(got) == collected(want) and got.count() > 0


def test_funnel_forms_agree(spark, folder):
    batch = spark.read.parquet(folder)
    assert collected(jobs.live_funnel(batch)) == collected(jobs.live_funnel(batch, chained=False))
    assert collected(jobs.session_agg(batch)) == collected(jobs.session_agg(batch, form="rows"))
    nulls = batch.withColumns({"session_id": F.when(F.col("event_id") % 2 == 0, F.col("session_id")), "customer_id": F.when(F.col("event_id") % 3 == 0, F.col("customer_id"))})
    assert collected(jobs.session_agg(nulls)) == collected(jobs.session_agg(nulls, form="rows"))


def test_sliding_windows_come_from_panes(spark, folder):
    """Rows are grouped once before they are in several windows, and no set of sessions is kept."""
    batch = spark.read.parquet(folder)
    for job in (jobs.trending_products, jobs.cart_abandonment):
        plan = job(batch)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Expand") < plan.rindex("Aggregate")  # printed from the top: expansion above the first grouping
    assert "collect_set" not in jobs.session_agg(batch)._jdf.queryExecution().optimizedPlan().toString()


def test_processing_time_trigger(spark, folder, tmp_path):
    """Batches come by the clock until the query is stopped, and what they leave is what is there."""
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = sinks.start_sink(stream, "clock", "append", "parquet", str(tmp_path / "ck"), str(tmp_path / "out"), trigger_seconds=1)
    deadline = time.monotonic() + 90
    while time.monotonic() < deadline and sum(p["numInputRows"] for p in q.recentProgress) < batch.count():
        time.sleep(0.5)
    running, progress = q.isActive, q.recentProgress
    q.stop()
    assert running and len([p for p in progress if p["numInputRows"]]) > 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_repeated_events_after_a_restart(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda m: dt.datetime(2024, 1, 1, 0, m).isoformat(" ")
    parts = [[("1", at(1)), ("2", at(2)), (None, at(2))], [("2", at(3)), ("3", "bad"), ("3", at(4)), (None, at(5))]]
    for rows in parts:
        spark.createDataFrame([(i, "s", "", " Purchase ", "p", t, "Web ") for i, t in rows], SCHEMA.replace("timestamp timestamp", "timestamp string")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA.replace("timestamp timestamp", "timestamp string")).parquet(src)
        sinks.start_sink(clean_click_stream(stream), "clicks-once", "append", "parquet", str(tmp_path / "ck"), str(tmp_path / "out"), available_now=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.event_id, r.event_timestamp.minute) for r in got), key=str) == sorted([("1", 1), ("2", 2), (None, 2), ("3", 4)], key=str)
    assert {(r.event_type, r.device_type, r.customer_id) for r in got} == {("purchase", "web", None)}


def runs_by_hand(rows, gap=600):
    keys, out = {}, []
    for r in rows:
        if r[3] in ("add_to_cart", "purchase"):
            keys.setdefault((r[1], r[2]), []).append((r[5], r[3] == "purchase", r[4]))
    for key, steps in keys.items():
        run = None
        for at, bought, product in sorted(steps, key=lambda s: s[:2]):
            if run and (at - run[1]).total_seconds() > gap:
                out.append((*key, *run))
                run = None
            run = None if bought else (run[0], at, run[2] + 1, run[3] | {product}) if run else (at, at, 1, {product})
        if run:
            out.append((*key, *run))
    return sorted(((*r[:5], tuple(sorted(p for p in r[5] if p))) for r in out), key=str)


def alerts(df):
    return sorted(((r.session_id, r.customer_id, r.first_cart, r.last_cart, r.carts, tuple(r.products)) for r in df.collect()), key=str)


def test_left_carts(spark, tmp_path):
    """Ties at one moment, purchases at the very end of a run, null keys and products; out of order in three runs of one query, then a late row."""
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    kinds = ["add_to_cart", "add_to_cart", "purchase", "page_view"]
    rows = [(str(i), f"s{rng.randrange(6)}", rng.choice(["c1", "c2", None]), rng.choice(kinds), rng.choice(["p1", "p2", None]), start + dt.timedelta(minutes=rng.randrange(400)), "web") for i in range(400)]
    want = runs_by_hand(rows)
    assert alerts(carts.left_carts(spark.createDataFrame(rows, SCHEMA))) == want and len(want) > 50
    rows.sort(key=lambda r: (r[5].hour, rng.random()))  # out of order by an hour at most
    late = ("late", "s0", "c1", "purchase", None, start, "web")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:130], rows[130:300], rows[300:], [late]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = carts.left_carts_stream(spark.readStream.schema(SCHEMA).parquet(src), delay="60 minutes")
        sinks.start_sink(stream, "carts", "append", "parquet", str(tmp_path / "ck"), out, available_now=True, rocksdb=True).awaitTermination(200)
    end = max(r[5] for r in rows) - dt.timedelta(minutes=60)
    assert alerts(spark.read.parquet(out)) == [r for r in want if r[3] + dt.timedelta(minutes=10) <= end]


def test_update_mode_upserts(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    keys = ["window_start", "window_end", "device_type"]
    sinks.start_upsert(jobs.session_agg(stream, form="rows"), "ups", keys, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    assert collected(sinks.latest(spark, str(tmp_path / "out"), keys)) == collected(jobs.session_agg(batch))
    assert len(list((tmp_path / "out").iterdir())) > 2  # several batches, so that windows were updated
    funnel = ["window_start", "window_end"]
    sinks.start_upsert(jobs.live_funnel(stream, chained=False), "funnel", funnel, str(tmp_path / "out2"), str(tmp_path / "ck2"), available_now=True).awaitTermination(120)
    assert collected(sinks.latest(spark, str(tmp_path / "out2"), funnel)) == collected(jobs.live_funnel(batch))
    with pytest.raises(ValueError):
        sinks.start_sink(jobs.session_agg(stream), "x", "update", "parquet", str(tmp_path / "c2"))


SCHEMA = "event_id string, session_id string, customer_id string, event_type string, product_id string, event_timestamp timestamp, device_type string"


def test_hand_made_rows(spark):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    rows = [("1", "a", None, "add_to_cart", "p", at(1), "web"), ("2", "b", "c", "add_to_cart", "p", at(1), "web"), ("3", "b", "c", "purchase", "p", at(3), "web"), ("4", "b", "c", "add_to_cart", "", at(30), "web")]
    rows += [(f"v{k}", "f", "c", "page_view", None, at(2, k % 60), "web") for k in range(201)]
    df = spark.createDataFrame(rows, SCHEMA)
    alerts = {(r.session_id, r.window_start.minute) for r in jobs.cart_abandonment(df).collect() if r.window_start.hour == 0}
    assert ("a", 0) in alerts and ("b", 0) not in alerts and ("b", 30) in alerts
    assert [r.session_id for r in jobs.velocity_anomaly(df).collect()] == ["f"]
    assert {r.product_id for r in jobs.trending_products(df).collect()} == {"p"}


def test_late_rows_are_dropped(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda m: dt.datetime(2024, 1, 1, 0, m)
    for k, m in enumerate((0, 40, 1, 41)):
        spark.createDataFrame([(str(k), "s", "c", "page_view", "p", at(m), "web")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        sinks.start_sink(jobs.session_agg(stream), "late", "append", "parquet", str(tmp_path / "ck"), str(tmp_path / "out"), available_now=True).awaitTermination(120)
    got = {r.window_start.minute for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 0 in got and 1 not in got


def test_kafka_values_and_file_source(spark, tmp_path):
    values = spark.createDataFrame([(b'{"event_id":"1","event_timestamp":"2024-01-01 00:00:00","device_type":"web"}', dt.datetime(2024, 1, 1)), (b"broken", dt.datetime(2024, 1, 1))], "value binary, timestamp timestamp")
    first, second = parse_kafka_value(values).collect()
    assert first.event_timestamp == dt.datetime(2024, 1, 1) and second.event_id is None
    src = tmp_path / "clicks"
    src.mkdir()
    head = "event_id,session_id,customer_id,event_type,page_url,product_id,event_timestamp,device_type,browser,referrer,raw_json\n"
    (src / "a.csv").write_text(head + '1,s,c,page_view,/,p,2024-01-01 00:00:00,web,b,r,"{""a"": ""x, y""}"\n2,s,c,page_view,/,p,bad,web,b,r,\n')
    q = file_events(spark, str(src)).writeStream.format("memory").queryName("clicks").trigger(availableNow=True).start()
    q.awaitTermination(60)
    (r,) = spark.sql("select * from clicks").collect()
    assert r.raw_json == '{"a": "x, y"}'


@pytest.mark.parametrize("name", ["q1_stream_deduplication", "x6_late_rows_dropped"])
def test_files_that_come_later_have_headers_of_their_own(spark, name):
    """Though they are larger than a split."""
    from shoplake import queries_jobs, queries_more  # noqa: F401 - register more of them
    from shoplake.queries import ORACLE_SQL, QUERIES
    from tests.oracle import compare

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name]) > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
