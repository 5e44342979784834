import datetime as dt

from pyspark.sql import functions as F

from shoplake.llm import urllists


def brute(url):
    """Host and path by hand, then every text that an entry may be."""
    head, slashes, rest = (url or "").partition("//")
    if not slashes or (head and not head.endswith(":")):
        return set()
    rest = rest.split("?")[0].split("#")[0]
    name, *parts = rest.split("/")
    name = name.rsplit("@", 1)[-1].lower()
    name = (name[: name.index("]") + 1] if name.startswith("[") else name.split(":")[0]).rstrip(".")
    labels = name.split(".")
    return {".".join(labels[i:]) + "".join("/" + p for p in parts[:n]) for i in range(max(1, len(labels) - 1)) for n in range(len(parts) + 1) if n == 0 or parts[n - 1]} if name else set()


URLS = ["http://m.casino-win.example.com", "https://www.Example.co.uk/", "http://h.net/a/b/c", "http://h.net:80/a/bc?x=/q/r#/s", "http://x.y.z.org//d/", "http://localhost/a", "http://a.io?u=b.io/c"]
URLS += ["http://u@evil.com/x", "http://u:p@a@evil.com:8080/x", "http://Evil.com./x", "//evil.com/x", "http://[2001:db8::1]:80/x", "http://user@/x", "http:///x", "evil.com/x", "mailto:a@evil.com", "http://evil.com?a@b.org"]


def test_keys_by_brute_force(spark):
    every = sorted(set().union(*map(brute, URLS)) | {"com", "uk", "z.org/", "evil.com/", "h.net/a/", "h.net/a/b/c/d"})
    texts = spark.createDataFrame([(e,) for e in every], "e string").select("e", urllists.key(F.substring_index("e", "/", 1), F.expr("substring(e, length(substring_index(e, '/', 1)) + 1)")).alias("k"))
    names = {r.k: r.e for r in texts.collect()}
    for depth in (0, 1, 9):
        rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urllists.keys(urllists.host(F.col("u")), urllists.path(F.col("u")), depth).alias("k")).collect()
        assert {r.u: {names[k] for k in r.k or ()} for r in rows} == {u: {e for e in brute(u) if e.count("/") <= depth} for u in URLS}


def test_judgement_by_brute_force(spark):
    day = dt.date(2024, 1, 1)
    entries = ["evil.com", "evil.com/x", "example.com", "h.net/a", "h.net/a/bc", "[2001:db8::1]", "x.y.z.org//d", "com", "localhost", "b.org", "user"]
    events = spark.createDataFrame([(e, "add", day) for e in entries], "entry string, action string, day date")
    caps = spark.createDataFrame([(i, u, day) for i, u in enumerate([*URLS, None, ""])] + [(None, URLS[0], day)] * 2, "page_id long, url string, fetched date")
    got = urllists.judge(caps, events).collect()
    assert len(got) == caps.count()
    assert all(r.entry == min((e for e in entries if e in brute(r.url)), default=None) for r in got)


def test_urls_of_many_parts(spark):
    day = dt.date(2024, 1, 1)
    long = "/".join(f"part{i}" for i in range(20_000))
    deep = "a.io/" + "/".join(f"part{i}" for i in range(3_000))
    events = spark.createDataFrame([(deep, "add", day), ("b.io/part0", "add", day)], "entry string, action string, day date")
    caps = spark.createDataFrame([(1, f"http://x.a.io/{long}", day), (2, f"http://b.io/{long}", day), (3, f"http://c.io/{long}", day)], "page_id long, url string, fetched date")
    got = {r.page_id: r.entry for r in urllists.judge(caps, events).collect()}
    assert got == {1: deep, 2: "b.io/part0", 3: None}


def test_entries_between_and_deeper(spark):
    day = dt.date(2024, 1, 1)
    entries = ["casino-win.example.com", "example.co.uk", "h.net/a/b"]
    events = spark.createDataFrame([(e, "add", day) for e in entries], "entry string, action string, day date")
    caps = spark.createDataFrame([(i, u, day) for i, u in enumerate([*URLS[:7], "http://other.example.com/a", None, ""])], "page_id long, url string, fetched date")
    got = {r.page_id: r.entry for r in urllists.judge(caps, events).collect()}
    assert got == {0: entries[0], 1: entries[1], 2: entries[2]} | dict.fromkeys(range(3, 10))
