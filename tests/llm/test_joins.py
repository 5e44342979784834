"""Hand-made rows for tool links, URL lists and revisits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shoplake.llm import chat, urllists, warc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
FIELDS = [chat.Field("search", "query", "string"), chat.Field("search", "limit", "long", False, 1, 9), chat.Field("search", "after", "string", False), chat.Field("search", "deep", "boolean", False)]


def test_links_order_schema_and_canonical_json(spark):
    calls = [
        (1, "a", 1, "search", '{ "query": "x", "limit": 5 }'), (1, "b", 3, "search", '{"limit":12,"after":"a","query":"é\\n"}'), (1, "c", 5, "search", '{"after":"b","query":"y","zzz":{"b":1,"a":[1,2.50]}}'),
        (2, "d", 1, "search", "not json"), (2, "e", 1, "other", "{}"), (2, "f", 1, "search", '{"after":"g","query":"q"}'), (2, "g", 2, "search", '{"after":"f","query":"q"}'), (2, "h", 2, "search", '{"after":"nowhere","query":3,"deep":"maybe"}'),
        (3, None, 1, None, None), (1, "a", 1, "search", '{ "query": "x", "limit": 5 }'),
    ]
    results = [(1, "a", 4, "late"), (1, "a", 2, "first"), (1, "zz", 1, "lost"), (1, None, 1, "none"), (2, "a", 1, "elsewhere"), (None, "a", 1, "nowhere")]
    clash = {"level": F.lit(9), "content": F.lit("x"), "n_results": F.lit(1), "args": F.lit("y"), "needed": F.lit("a")}
    made = spark.createDataFrame(calls, CALLS).withColumns(clash)
    out = chat.link(made, spark.createDataFrame(results, RESULTS).withColumns({"name": F.lit("clash"), "errors": F.lit(1)}), FIELDS).collect()
    got = {r.call_id: r for r in out if r.conv_id is not None and r.call_id and r.errors != "orphan_result"}
    assert [got[k].level for k in "abcdfgh"] == [0, 1, 2, 0, None, None, 0]
    assert got["a"].result == "first" and got["a"].n_results == 2 and sum(r.call_id == "a" and r.errors != "orphan_result" for r in out) == 2
    assert got["b"].errors == "high:limit" and got["c"].errors == "unknown_field" and got["d"].errors == "not_json" and got["e"].errors == "unknown_tool" and "type:deep" in got["h"].errors
    assert got["c"].canonical == '{"arguments":{"after":"b","query":"y","zzz":{"a":[1,2.5],"b":1}},"id":"c","name":"search"}' and got["d"].canonical is None
    assert sorted(r.result for r in out if r.errors == "orphan_result") == ["elsewhere", "lost", "none", "nowhere"]
    assert [(r.canonical, r.level) for r in out if r.conv_id == 3] == [(None, 0)]
    none = spark.createDataFrame([], CALLS)
    assert chat.link(none, spark.createDataFrame([], RESULTS), FIELDS).count() == 0


def test_one_form_of_json(spark):
    same = ["100", "1e2", "100.0", "1.0e2", "10000e-2", "0.1E+3"]
    assert {chat.canonical_json(f'{{"b":{x}, "a":[ {x}]}}') for x in same} == {'{"a":[100],"b":100}'}
    texts = ["-0.0", "0.10", "1e-7", "123456789012345678901", "1e21", "1.5E+300", "-12.50", "0.000001", '"1.0e2 \\u00e9\\n\\""', "[]", "{}", "true", "null"]
    assert [chat.canonical_json(t) for t in texts] == ["0", "0.1", "1e-7", "123456789012345678901", "1e+21", "1.5e+300", "-12.5", "0.000001", '"1.0e2 é\\n\\""', "[]", "{}", "true", "null"]
    assert chat.canonical_json('{"\\ud83d\\ude00":1,"\\ufb33":2,"a":3}') == '{"a":3,"\U0001f600":1,"\ufb33":2}'  # by UTF-16 code units
    assert [chat.canonical_json(t) for t in ("", "{", "[" * 100_000, None)] == [None] * 4
    calls = [(1, 'q"uote', 1, 'se"arch', '{"x":1e2}'), (1, "n", 2, None, '{"x":"' + "long " * 50_000 + '"}')]
    got = {r.turn: r.canonical for r in chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), FIELDS).collect()}
    assert got[1] == '{"arguments":{"x":100},"id":"q\\"uote","name":"se\\"arch"}'
    assert got[2].endswith(',"id":"n","name":null}') and len(got[2]) > 250_000


def test_identifiers_of_one_conversation(spark):
    calls = [(1, "x", 1, "search", "{}"), (1, "y", 2, "search", '{"after":["x"]}'), (2, "y", 1, "search", '{"after":"x"}'), (2, "z", 2, "search", '{"after":["y","x","y"]}')]
    out = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(2, "y", 1, "two"), (3, "x", 1, "three")], RESULTS), FIELDS).collect()
    assert sorted((r.conv_id, r.call_id, r.level, r.result) for r in out if r.errors != "orphan_result") == [(1, "x", 0, None), (1, "y", 1, None), (2, "y", 0, "two"), (2, "z", 1, None)]


def test_long_chains_and_cycles_behind(spark):
    calls = spark.createDataFrame([(7, f"n{i}") for i in range(300)] + [(7, "x"), (7, "y"), (7, "z")], "conv_id long, call_id string")
    needs = spark.createDataFrame([(7, f"n{i}", f"n{i - 1}") for i in range(1, 300)] + [(7, "x", "y"), (7, "y", "x"), (7, "z", "x"), (7, "n0", "gone")], "conv_id long, call_id string, needed string")
    got = {r.call_id: r.level for r in chat.levels(calls, needs).collect()}
    assert got == {f"n{i}": i for i in range(300)} | {"x": None, "y": None, "z": None}


def test_lists_in_force(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = [("bad.example.com", "add", day(5)), ("bad.example.com", "remove", day(10)), ("bad.example.com", "add", day(20)), ("bad.example.com", "add", day(21)), ("example.org", "remove", day(1)), ("example.org", "add", day(3)), ("h.net/x", "add", day(0)), ("same.io", "add", day(4)), ("same.io", "remove", day(4)), (None, "add", day(0)), ("h.net", "add", None)]
    e = spark.createDataFrame(events, "entry string, action string, day date")
    rows = [(1, "http://bad.example.com/a", day(4), False), (2, "http://BAD.example.com/a", day(5), True), (3, "http://bad.example.com", day(10), False), (4, "http://bad.example.com:80/", day(400), True), (5, "https://www.example.org/x?y", day(3), True), (6, "http://h.net/x/deep", day(1), True), (7, "http://h.net/xx", day(1), False), (8, "http://same.io/", day(5), False), (9, None, day(9), False), (10, "", day(9), False), (11, "http://bad.example.com/a", None, False), (2, "http://BAD.example.com/a", day(5), True)]
    caps = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, fetched date").withColumn("entry", F.lit("clash"))
    got = sorted((r.page_id, r.blocked) for r in urllists.judge(caps, e).collect())
    assert got == sorted((r[0], r[3]) for r in rows)
    assert urllists.judge(caps, e.limit(0)).filter("blocked").count() == 0 and urllists.judge(caps.limit(0), e).count() == 0


def test_long_histories_and_buckets(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = spark.createDataFrame([("a.io", "remove" if n % 3 == 1 else "add", day(n)) for n in range(0, 900, 2)], "entry string, action string, day date")
    caps = spark.createDataFrame([(n, "http://a.io/" + "p" * 20_000, day(n)) for n in range(-5, 910)], "page_id long, url string, fetched date")
    held, want = False, {}
    for n in range(-5, 910):
        if 0 <= n < 900 and n % 2 == 0:
            held = n % 3 != 1
        want[n] = held
    for days in (1, 10, 64, 5000):
        assert {r.page_id: r.blocked for r in urllists.judge(caps, events, days).collect()} == want


def brute_revisits(rows):
    out = {}
    weak = lambda tag: tag[2:] if tag and tag.startswith("W/") else tag
    for rid, url, ts, status, etag, lm, _ in rows:
        if status != 304:
            out[rid] = ("full", None)
            continue
        prior = [r for r in rows if r[3] == 200 and url is not None and ts is not None and r[1] == url and r[2] is not None and r[2] < ts]
        if not prior:
            out[rid] = ("no_earlier", None)
            continue
        p = max(prior, key=lambda r: (r[2], r[0]))
        same = weak(etag) == weak(p[4]) if etag is not None and p[4] is not None else lm is not None and lm == p[5]
        out[rid] = ("resolved", p[0]) if same else ("validator_mismatch", None)
    return out


CAPTURES = "record_id long, url string, ts long, status int, etag string, last_modified string, headers map<string,string>"


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_revisits_by_brute_force(spark, parts):
    rows = []
    for i in range(400):
        url = None if i % 41 == 0 else f"h{i % 3 if i % 2 else 0}.io/p"  # one URL holds most rows
        rows.append((i, url, None if i % 37 == 0 else i * 7919 % 500, 200 if i % 4 == 0 else 304, [None, "a", "b", "W/a"][i % 4 if i % 5 else 3], [None, "t1", "t2", "t1"][i % 4], {"DATE": str(i), "content-length": "0"} if i % 4 else {"Content-Length": "9", "etag": "a", "date": "d", "ETag": "b"}))
    caps = spark.createDataFrame(rows, CAPTURES).withColumns({"range": F.lit(1), "near": F.lit("x"), "canonical": F.lit("y"), "found": F.lit(2)})
    got = {r.record_id: (r.outcome, r.source_id) for r in warc.resolve(caps, parts).collect()}
    assert got == brute_revisits(rows) and {"resolved", "validator_mismatch", "no_earlier", "full"} == {o for o, _ in got.values()}
    for r in warc.resolve(caps, parts).filter("outcome = 'resolved'").collect():
        assert r.headers == f'{{"content-length":"9","date":"{r.record_id}","etag":"a"}}'
    assert warc.resolve(caps.limit(0)).count() == 0
    twice = warc.resolve(caps.unionByName(caps), parts)
    assert twice.count() == 800 and {r.record_id: (r.outcome, r.source_id) for r in twice.collect()} == got


def test_revisits_without_headers_or_status(spark):
    rows = [(1, "http://a.io/" + "x" * 50_000, 1, 200, "e", None, None), (2, "http://a.io/" + "x" * 50_000, 2, 304, "e", None, {"Date": "d"}), (3, "u", None, None, None, None, {None: "v"} if False else {"A": None})]
    got = {r.record_id: (r.outcome, r.source_id, r.headers) for r in warc.resolve(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert got[1][:2] == ("full", None) and got[2] == ("resolved", 1, '{"date":"d"}') and got[3][0] == "full"


def test_canonical_urls(spark):
    urls = ["https://WWW.Shop.io/A.html?utm_source=1#y", "http://m.shop.io/A", "shop.io/A/?", "http://shop.io", "", None, "http://s.io/p?id=2&a=1&&ref=x", "http://s.io/p.html?a=1&id=2#z", "http://s.io?q=1/", "http://s.io/p?reference=1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical(F.col("u"))).collect()]
    assert got == ["shop.io/A", "shop.io/A", "shop.io/A", "shop.io", "", None, "s.io/p?a=1&id=2", "s.io/p?a=1&id=2", "s.io?q=1/", "s.io/p?reference=1"]


def test_results_without_content_or_turn(spark):
    calls = spark.createDataFrame([(1, "a", 1, "search", "{}"), (1, "b", 2, "search", "{}"), (1, "c", 3, "search", "{}"), (1, "d", 4, "search", "{}")], CALLS)
    results = [(1, "a", 5, None), (1, "b", None, "no turn"), (1, "b", 9, "late"), (1, "c", 4, None), (1, "c", 4, "of one turn")]
    out = {r.call_id: (r.linked, r.n_results, r.result) for r in chat.link(calls, spark.createDataFrame(results, RESULTS), FIELDS).collect()}
    assert out == {"a": (True, 1, None), "b": (True, 2, "late"), "c": (True, 2, "of one turn"), "d": (False, 0, None)}
