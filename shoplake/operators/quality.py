"""Deduplication and data-quality rules, counted in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

REPORT = "table string, total_rows long, valid_rows long, pass_rate double, issues array<struct<rule:string,count:long,details:string>>"


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; null keys are equal, as in any grouping."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def not_in_future(df: DataFrame, column: str, day: Column) -> DataFrame:
    """Drops later dates; null dates stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) <= day))


def min_age(df: DataFrame, column: str, day: Column, days: int = 365 * 16) -> DataFrame:
    """Drops those born less than ``days`` before ``day``; null dates stay."""
    return df.filter(F.col(column).isNull() | (F.datediff(day, column) >= days))


def in_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Keeps [lo, hi]; nulls fail."""
    return df.filter(F.col(column).between(lo, hi))


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) > 0))


def non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) >= 0))


class Rule(NamedTuple):
    """``fails`` is true for rows that break the rule; they are dropped if ``drops``. Quiet rules are left out at 0."""

    name: str
    fails: Column
    drops: bool = True
    details: str = ""
    quiet: bool = False


def apply_rules(df: DataFrame, table: str, rules: Sequence[Rule], unique: tuple[str, Sequence[str], Sequence[Column]] | None = None, report_duplicates: bool = True, seen: Observation | None = None) -> tuple[DataFrame, DataFrame | Callable[[], DataFrame]]:
    """(rows that pass, one-row report). Rules are sequential: each counts rows that the ones before let through.

    ``unique`` (rule name, keys, order) comes first. All counts come from one
    aggregate over flags. With ``seen`` they are taken from the very pass that
    uses the rows: the second value is then a function that gives the report once that pass, a write of the rows, is over.
    """
    flagged, counted = df, []
    alive = F.lit(True)
    if unique:
        name, keys, order = unique
        flagged = flagged.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
        if report_duplicates:
            counted.append((name, ~F.col("_first"), "", True))
        alive = F.col("_first")
    for r in rules:
        fails = F.coalesce(r.fails, F.lit(False))
        counted.append((r.name, alive & fails, r.details, r.quiet))
        if r.drops:
            alive = alive & ~fails
    flagged = flagged.withColumn("_alive", alive)
    sums = [F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(f"_c{i}") for i, (_, flag, _, _) in enumerate(counted)]
    totals = [F.count("*").alias("total_rows"), F.coalesce(F.sum(F.col("_alive").cast("long")), F.lit(0)).alias("valid_rows")]
    if seen is not None:
        flagged = flagged.observe(seen, *totals, *sums)
    issues = F.array_compact(F.array(*[F.when(F.lit(not quiet) | (F.col(f"_c{i}") > 0), F.struct(F.lit(name).alias("rule"), F.col(f"_c{i}").alias("count"), F.lit(details).alias("details"))) for i, (name, _, details, quiet) in enumerate(counted)])) if counted else F.array().cast("array<struct<rule:string,count:long,details:string>>")
    rate = F.round(F.col("valid_rows") * 100.0 / F.greatest("total_rows", F.lit(1)), 2)
    shown = lambda one: one.select(F.lit(table).alias("table"), "total_rows", "valid_rows", rate.alias("pass_rate"), issues.alias("issues"))
    report = shown(flagged.agg(*totals, *sums)) if seen is None else lambda: shown(df.sparkSession.createDataFrame([seen.get]))
    return flagged.filter("_alive").drop("_alive", "_first"), report


def dq_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.sum("total_rows").alias("rows_in"), F.sum("valid_rows").alias("rows_out")).withColumn("pass_rate", F.round(F.col("rows_out") * 100.0 / F.greatest("rows_in", F.lit(1)), 2))
