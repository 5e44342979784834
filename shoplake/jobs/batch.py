"""The batch run: marts from cleaned tables, written and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.jobs import analytics
from shoplake.jobs.clean import run_etl
from shoplake.operators.basket import product_affinity
from shoplake.sources.files import ingest_csv_to_parquet, read_parquet, write_dq_report, write_parquet


def run_all(tables: dict[str, DataFrame], dst: str, as_of, rel_err: float = 0.05) -> dict[str, DataFrame]:
    """Write RFM, affinity, daily KPI and CLV marts; returns segment, pair and tier counts, read from what was written."""
    orders = tables["orders"].withColumn("order_date", F.col("order_date").cast("date"))
    spark = orders.sparkSession
    write_parquet(analytics.rfm_quantile(orders, as_of, rel_err), f"{dst}/rfm_scores")
    write_parquet(product_affinity(tables["order_items"]), f"{dst}/product_affinity")
    write_parquet(analytics.daily_kpis(orders), f"{dst}/daily_kpis", partition_by="order_date")
    write_parquet(analytics.clv_batch(orders), f"{dst}/clv_scores")
    return {
        "segments": analytics.segment_counts(read_parquet(spark, f"{dst}/rfm_scores"), "segment"),
        "pairs": read_parquet(spark, f"{dst}/product_affinity").agg(F.count("*").alias("rows")),
        "tiers": analytics.segment_counts(read_parquet(spark, f"{dst}/clv_scores"), "tier"),
    }


def from_files(spark: SparkSession, src: str, dst: str, as_of) -> dict[str, DataFrame]:
    """CSV files to Parquet, cleaning with its report, then the marts: the marts need columns that only cleaning makes."""
    loaded = ingest_csv_to_parquet(spark, src, f"{dst}/raw")
    clean, report = run_etl({t: read_parquet(spark, f"{dst}/raw/{t}") for t in loaded}, as_of)
    write_dq_report(report, f"{dst}/dq_report")
    for name, df in clean.items():
        write_parquet(df, f"{dst}/clean/{name}")
    return run_all({t: read_parquet(spark, f"{dst}/clean/{t}") for t in clean}, f"{dst}/marts", as_of)
