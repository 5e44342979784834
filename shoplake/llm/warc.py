"""Not-modified revisits resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.llm.store import written

#: Headers that a 304 response may change in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


#: Query parameters that name where a visitor came from, not a page.
TRACKING = "^(utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)"


def canonical(url: Column) -> Column:
    """Scheme, fragment, leading www. or m., a closing slash and .html go; the host is lower-cased.

    The query stays: its parameters are sorted, empty and tracking ones go.
    """
    bare = F.regexp_replace(url, "(?s)^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    at = F.regexp_extract(bare, "^[^/?]*", 0)
    name = F.regexp_replace(F.lower(at), "^(www|m)\\.", "")
    rest = F.substring(bare, F.length(at) + 1, 1 << 30)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "(\\.html|/)$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "(?s)\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(name, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def one_form(headers: Column) -> Column:
    """Entries of a header map by lower-cased name, sorted; of names that differ in case only, the one with the least value."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    first = lambda sorted_: F.filter(sorted_, lambda e, i: (i == 0) | (F.get(sorted_, i - 1)["key"] != e["key"]))
    return F.element_at(F.transform(F.array(entries), first), 1)  # a lambda's variable is computed once


def latest_before(rows: DataFrame, key: str, ts: str, full: Column, payload: Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``found``: ``payload`` of the latest row with ``full`` and a strictly smaller ``ts`` (long) under the same key.

    Rows are dealt by ranges of (key, time), so a very frequent key is cut into
    several ranges of equal size: a row is looked up within its range first,
    else in the last earlier range of its key that has a full row, out of a
    table with one row per key and range. Bounds of ranges are sampled, so the
    rows are pinned by a written table. Rows of one key and one time stay
    together; rows without a key find nothing and are dealt by their hash.
    """
    by = [F.col(key), F.col(ts)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    loose = -1 - F.pmod(F.xxhash64("record_id"), F.lit(4096))
    rows = written(dealt.select("*", F.when(F.col(key).isNull(), loose).otherwise(F.spark_partition_id()).alias("range")), "warc-ranges")
    stamped = F.when(full, F.struct(F.col(ts).alias("ts"), payload.alias("payload")))
    inside = Window.partitionBy(key, "range").orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(stamped).over(inside))
    last = rows.filter(F.col(key).isNotNull()).groupBy(key, "range").agg(F.max(stamped).alias("last"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "range", F.max("last").over(before).alias("carried")).filter("carried is not null")
    return near.join(carried, [key, "range"], "left").withColumn("found", F.coalesce("near", "carried")).drop("near", "carried", "range")


def resolve(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """Outcome of every capture (record_id, url, ts seconds, status, etag, last_modified, headers map).

    A 304 is ``resolved`` if the latest earlier 200 of its canonical URL has the
    same entity tag, or, where either has none, the same modification date;
    else ``validator_mismatch``, or ``no_earlier``. Tags are compared weakly, as
    conditional requests do: W/ before a tag doesn't count. A resolved record
    takes the stored headers with the permitted ones of the 304 over them;
    header names are lower-cased. Other rows are ``full``. Of full responses of
    one second the largest record_id counts. Null URLs find nothing; captures
    without a time keep outcome no_earlier; a null status counts as not 304.
    Repeated rows are resolved one by one, whatever the length of a URL; other
    columns of ``captures`` are ignored, an empty table gives no rows.
    ``parts`` sets the number of ranges; Spark's own is the default.
    """
    rows = captures.select("record_id", canonical(F.col("url")).alias("canonical"), "ts", "status", "etag", "last_modified", one_form(F.col("headers")).alias("entries"))
    payload = F.struct("record_id", "etag", "last_modified", "entries")
    full = (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    found = latest_before(rows, "canonical", "ts", full, payload, parts)
    p = F.col("found.payload")
    tags = F.col("etag").isNotNull() & p["etag"].isNotNull()
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    same = F.coalesce(F.when(tags, weak(F.col("etag")) == weak(p["etag"])).otherwise(F.col("last_modified") == p["last_modified"]), F.lit(False))
    is_304 = F.coalesce(F.col("status") == 304, F.lit(False))
    outcome = F.when(~is_304, "full").when(p.isNull() | F.col("canonical").isNull(), "no_earlier").when(same, "resolved").otherwise("validator_mismatch")
    allowed = F.coalesce(F.filter("entries", lambda e: e["key"].isin(*PERMITTED)), F.array().cast("array<struct<key:string,value:string>>"))
    stored = F.filter(p["entries"], lambda e: ~F.array_contains(F.transform(allowed, lambda a: a["key"]), e["key"]))
    merged = F.to_json(F.map_from_entries(F.array_sort(F.concat(F.coalesce(stored, F.array().cast("array<struct<key:string,value:string>>")), allowed))))
    out = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return out.select("record_id", "canonical", "ts", "status", "outcome", F.when(resolved, p["record_id"]).alias("source_id"), F.when(resolved, merged).when(F.col("outcome") == "full", F.to_json(F.map_from_entries("entries"))).alias("headers"))
