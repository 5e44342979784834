"""Slowly changing dimensions, surrogate keys and point-in-time reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplake.functions.expr import as_date
from shoplake.operators.quality import dedupe_keep_first


def scd2_merge(dim: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], as_of, latest: Column | None = None) -> DataFrame:
    """Type 2 merge: changed rows are closed at ``as_of`` and opened anew in the same run; new keys are opened.

    ``dim`` has the source's columns and start_date, end_date, is_current;
    versions hold in [start, end). Comparison is null-safe, of several source
    rows for a key the one with the greatest ``latest`` wins, and a rerun on the
    same day changes nothing: a version opened that day is replaced in place.
    Closed history takes no part in the join.
    """
    day, columns = as_date(as_of), source.columns
    order = [latest.desc_nulls_last()] if latest is not None else []
    src = dedupe_keep_first(source.filter(F.col(key).isNotNull()), [key], [*order, *[F.col(c).asc_nulls_last() for c in columns]])
    current, closed = dim.filter("is_current"), dim.filter("not is_current")
    s = src.select(F.struct(*columns).alias("s"), F.col(key).alias("_k"))
    d = current.select(F.struct(*dim.columns).alias("d"), F.col(key).alias("_k"))
    both = d.join(s, "_k", "full_outer")
    changed = F.lit(False)
    for c in tracked:
        changed = changed | ~F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    has_d, has_s = F.col("d").isNotNull(), F.col("s").isNotNull()
    opened = F.struct(*[F.col(f"s.{c}").alias(c) for c in columns], day.alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    kept = F.struct(*[F.col(f"d.{c}").alias(c) for c in (*columns, "start_date", "end_date", "is_current")])
    ended = F.struct(*[F.col(f"d.{c}").alias(c) for c in columns], F.col("d.start_date").alias("start_date"), day.alias("end_date"), F.lit(False).alias("is_current"))
    same_day = F.col("d.start_date") >= day
    rows = F.when(has_d & (~has_s | ~changed), F.array(kept)).when(~has_d | same_day, F.array(opened)).otherwise(F.array(ended, opened))
    merged = both.select(F.explode(rows).alias("r")).select("r.*")
    return merged.unionByName(closed.select(*merged.columns))


def surrogate_keys(df: DataFrame, natural_key: str, existing: DataFrame | None = None, name: str = "sk") -> DataFrame:
    """Dense keys for the natural keys that ``existing`` (natural_key, name) lacks, above its greatest; known ones keep theirs."""
    from shoplake.operators.ranking import global_row_number

    keys = df.select(natural_key).filter(F.col(natural_key).isNotNull()).distinct()
    if existing is None:
        return df.join(global_row_number(keys, [F.col(natural_key)], name), natural_key, "left")
    known = existing.select(natural_key, name)
    top = known.agg(F.coalesce(F.max(name), F.lit(0)).alias("_top"))
    new = global_row_number(keys.join(known, natural_key, "left_anti"), [F.col(natural_key)], name)
    new = new.crossJoin(F.broadcast(top)).select(natural_key, (F.col(name) + F.col("_top")).alias(name))
    return df.join(known.withColumn(name, F.col(name).cast("long")).unionByName(new.withColumn(name, F.col(name).cast("long"))), natural_key, "left")


def as_of(dim: DataFrame, day) -> DataFrame:
    """Versions that held on ``day``."""
    d = as_date(day)
    return dim.filter((F.col("start_date") <= d) & (F.col("end_date").isNull() | (d < F.col("end_date"))))


SLICES = ("is_current", "closed_on")


def _slices(spark: SparkSession, path: str) -> DataFrame:
    """Values in folder names have no type of their own."""
    return spark.read.parquet(path).withColumns({"is_current": F.col("is_current").cast("boolean"), "closed_on": F.col("closed_on").cast("string")})


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return _slices(spark, path).drop("closed_on")


def scd2_merge_into(spark: SparkSession, path: str, source: DataFrame, key: str, tracked: Sequence[str], as_of, latest: Column | None = None) -> None:
    """``scd2_merge`` into a stored dimension whose closed history is neither read nor written.

    The table is stored by is_current and closed_on. A run reads the current slice,
    adds the versions it closes to the slice of its own day, and replaces the
    current slice last; a run that broke off is repeated and adds nothing twice.
    """
    from shoplake.functions.store import written

    day = str(as_of)
    current = _slices(spark, path).filter("is_current")
    merged = written(scd2_merge(current.drop("closed_on"), source, key, tracked, as_of, latest), "merged-slice")
    sliced = merged.withColumn("closed_on", F.coalesce(F.col("end_date").cast("string"), F.lit("open")))
    there = _slices(spark, path).filter((~F.col("is_current")) & (F.col("closed_on") == day)).select(F.col(key).alias("_k"), F.col("start_date").alias("_s"))
    closed = sliced.filter("not is_current")
    fresh = written(closed.join(there, closed[key].eqNullSafe(F.col("_k")) & (F.col("start_date") == F.col("_s")), "left_anti"), "closed-slice")
    if not fresh.isEmpty():
        fresh.write.mode("append").partitionBy(*SLICES).parquet(path)
    sliced.filter("is_current").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SLICES).parquet(path)


def store_slices(dim: DataFrame, path: str) -> None:
    """A dimension as ``scd2_merge_into`` keeps it."""
    dim.withColumn("closed_on", F.coalesce(F.col("end_date").cast("string"), F.lit("open"))).repartition("is_current", "closed_on").write.partitionBy(*SLICES).parquet(path)


def as_of_join(fact: DataFrame, dim: DataFrame, key: str, ts: str, how: str = "left", bucket_days: int | None = None) -> DataFrame:
    """Each fact row with the version of its key that held at ``ts``: an equi-join with a range condition.

    With ``bucket_days``, facts and versions meet by key and stretch of so many
    days, a version in each that it reaches into between the first and last fact, so that a key that has most of
    the facts is dealt out by time and a version meets only the facts of its stretches.
    """
    if bucket_days:
        first, last = fact.agg(F.min(F.col(ts).cast("date")), F.max(F.col(ts).cast("date"))).first()
        if first is None:
            return as_of_join(fact, dim, key, ts, how)
        number = lambda day: F.floor(F.unix_date(day) / bucket_days)
        lo = F.greatest(F.col("start_date").cast("date"), F.lit(first))
        hi = F.least(F.coalesce(F.col("end_date").cast("date"), F.lit(last)), F.lit(last))
        reach = dim.filter((F.col("start_date").cast("date") <= F.lit(last)) & (F.col("end_date").isNull() | (F.col("end_date").cast("date") >= F.lit(first))) & (F.col("end_date").isNull() | (F.col("start_date") < F.col("end_date"))))
        dealt = reach.withColumn("_bucket", F.explode(F.sequence(number(lo), number(hi))))
        rows = fact.withColumn("_bucket", number(F.col(ts).cast("date")))
        versions = dealt.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.struct([c for c in dim.columns if c not in (key, "start_date", "end_date", "is_current")]).alias("_v"), "start_date", "end_date")
        on = (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")) & (F.col("start_date") <= F.col(ts)) & (F.col("end_date").isNull() | (F.col(ts) < F.col("end_date")))
        return rows.join(versions, on, how).select(*fact.columns, "_v.*", "start_date")
    versions = dim.select(F.col(key).alias("_k"), F.struct([c for c in dim.columns if c not in (key, "start_date", "end_date", "is_current")]).alias("_v"), "start_date", "end_date")
    on = (F.col(key) == F.col("_k")) & (F.col("start_date") <= F.col(ts)) & (F.col("end_date").isNull() | (F.col(ts) < F.col("end_date")))
    return fact.join(versions, on, how).select(*fact.columns, "_v.*", "start_date")


def intervals_overlap(dim: DataFrame, key: str) -> DataFrame:
    """Versions that begin before the one before has ended: none, if the dimension is sound."""
    w = Window.partitionBy(key).orderBy("start_date")
    return dim.withColumn("_prev_end", F.lag(F.coalesce("end_date", F.lit("9999-12-31").cast("date"))).over(w)).filter("start_date < _prev_end").drop("_prev_end")
