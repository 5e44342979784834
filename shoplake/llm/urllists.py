"""URL filters: captures judged by the list entries in force when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.llm.store import written


#: Scheme or none, user information or none, then the host, which may be an address in brackets.
HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)"


def host(url: Column) -> Column:
    """The host in lower case without the dots at its end; user information and port aside. Empty where a URL has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HEAD, 1)), r"\.+$", "")


def path(url: Column) -> Column:
    """From the slash after the host to query or fragment; empty without one."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+(/[^?#]*)", 1)


def key(name: Column, under: Column) -> Column:
    return F.xxhash64(F.xxhash64(name), F.xxhash64(under))


def keys(name: Column, under: Column, depth: int) -> Column:
    """Hashes of what entries may name: a host and every suffix of it of two labels or more, each alone and with every prefix of the path of at most ``depth`` whole parts.

    A host of one label is a key as it is. A hash stands for each, so that a long URL makes many keys but no long ones.
    """
    labels = F.split(name, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.xxhash64(F.call_function("substring_index", name, F.lit("."), n - F.size(labels) - 1)))
    # The first part is what stands before the first slash: nothing, so that the host alone is a key.
    parts = F.least(F.size(F.split(under, "/")), F.lit(depth + 1))
    prefix = lambda n: F.call_function("substring_index", under, F.lit("/"), n)
    ends = F.filter(F.sequence(F.lit(1), parts), lambda n: ~prefix(n).endswith("/"))
    paths = F.transform(ends, lambda n: F.xxhash64(prefix(n)))
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.xxhash64(s, p))))
    return F.when(name != "", F.array_distinct(found))


def intervals(events: DataFrame) -> DataFrame:
    """Dated entries (entry, action 'add' or 'remove', day) to validity intervals [since, until), until null while it holds.

    Of one entry's events on one day a removal counts last; an addition while
    the entry holds, or a removal while it doesn't, changes nothing.
    """
    rows = events.filter("entry is not null and day is not null").groupBy("entry", "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    w = Window.partitionBy("entry").orderBy("day")
    turns = rows.withColumn("was", F.lag("removed", 1, 1).over(w)).filter("removed <> was")
    return turns.withColumn("until", F.lead("day").over(w)).filter("removed = 0").select("entry", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, events: DataFrame, bucket_days: int = 64) -> DataFrame:
    """All rows of ``captures`` (page_id, url, fetched) with ``blocked``, the first matching ``entry`` and its ``since``.

    An as-of join in time buckets: intervals are dealt to the buckets they
    reach into, captures to the bucket of their fetch day, and both meet by
    equal key and bucket, so a capture meets half as many intervals of an entry
    as a bucket has days at most, however long the entry's history is. A key
    that very many captures share is on the larger side of the join only, where
    it can be split. Rows are told apart by their place, pinned by a written
    table. Null URLs or dates match nothing, repeated rows are judged one by
    one, URLs are read whole whatever their length, other columns of
    ``captures`` are ignored, an empty list blocks nothing and an empty table
    gives no rows.
    """
    rows = written(captures.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", "fetched"), "captures")
    first, last = rows.agg(F.min("fetched"), F.max("fetched")).first()
    number = lambda day: F.floor(F.unix_date(day) / bucket_days).cast("int")
    e_host = F.substring_index("entry", "/", 1)
    e_path = F.substring(F.col("entry"), F.length(e_host) + 1, F.length("entry"))
    span = F.sequence(number(F.greatest("since", F.lit(first).cast("date"))), number(F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))))
    dated = intervals(events).filter((F.col("since") <= F.lit(last).cast("date")) & (F.col("until").isNull() | (F.col("until") > F.lit(first).cast("date"))))
    dealt = dated.select("entry", "since", "until", key(e_host, e_path).alias("key"), F.explode(span).alias("bucket"))
    deepest = dated.agg(F.coalesce(F.max(F.size(F.split("entry", "/")) - 1), F.lit(0))).first()[0]
    parts = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    asked = parts.filter("fetched is not null").select("rid", "fetched", number(F.col("fetched")).alias("bucket"), F.explode(keys(F.col("host"), F.col("path"), deepest)).alias("key"))
    met = asked.join(dealt, ["key", "bucket"]).filter((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))).select("rid", "entry", "since")
    named = (F.col("host") == e_host) | F.col("host").endswith(F.concat(F.lit("."), e_host))
    under = (e_path == "") | (F.col("path") == e_path) | F.col("path").startswith(F.concat(e_path, F.lit("/")))
    hits = parts.select("rid", "host", "path").join(met, "rid").filter(named & under)
    best = hits.groupBy("rid").agg(F.min(F.struct("entry", "since")).alias("hit"))
    return rows.join(best, "rid", "left").select("page_id", "url", "fetched", F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("entry"), F.col("hit.since").alias("since"))
