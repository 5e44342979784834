"""Reading and writing files of the pipeline."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplake.sources.schemas import TABLES

log = logging.getLogger(__name__)
#: Spellings of null in staged files.
NULLS = ("NULL", "null", "")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: How dates and times are spelt in staged files.
FORMATS = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def _nulls(df: DataFrame) -> DataFrame:
    """Every spelling of null to null."""
    return df.withColumns({n: F.when(~F.col(n).isin(*NULLS), F.col(n)) for n, kind in df.dtypes if kind == "string"})


def read_stage_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Header, double quotes doubled inside, every spelling of null to null; an alien file fails instead of being read by position.

    ``multi_line`` allows line feeds inside quotes; such a file can't be split, so it is read by one task.
    """
    return _nulls(spark.read.schema(schema).options(header=True, quote='"', escape='"', enforceSchema=False, multiLine=multi_line, **FORMATS).csv(path))


def read_stage_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of an outer array become rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_load_metadata(df: DataFrame) -> DataFrame:
    """Load time, source file and a row number that keeps the order within a file (not dense)."""
    return df.select("*", F.current_timestamp().alias("_load_timestamp"), F.col("_metadata.file_path").alias("_source_file"), F.monotonically_increasing_id().alias("_row_number"))


def ingest_csv_to_parquet(spark: SparkSession, src: str, dst: str, tables: Sequence[str] = tuple(TABLES), multi_line: bool = False) -> dict[str, int]:
    """Each table's CSV to Parquet; missing files are skipped. Row counts are read from the files written."""
    counts = {}
    for t in tables:
        if not _exists(spark, f"{src}/{t}.csv"):
            log.warning("%s.csv is missing", t)
            continue
        write_parquet(read_stage_csv(spark, f"{src}/{t}.csv", TABLES[t], multi_line), f"{dst}/{t}")
        counts[t] = spark.read.parquet(f"{dst}/{t}").count()
    return counts


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, dynamic: bool = False) -> None:
    """Overwrite; rows meet by partition value first, so a date has few files. ``dynamic`` replaces only the slices written."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    df.repartition(partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(partition_by).parquet(path)


refresh_table = write_parquet


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Files with a header each; ``append`` adds files to those that are there."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_dq_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def load_new_files(spark: SparkSession, src: str, schema: str, dst: str, checkpoint: str) -> StreamingQuery:
    """Load files not loaded before, keep the sources, put rows that don't parse beside the table; waits for the end."""
    rows = spark.readStream.schema(schema + ", _corrupt_record string").options(header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **FORMATS).csv(src)

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _nulls(batch.filter("_corrupt_record is null").drop("_corrupt_record")).write.mode("overwrite").parquet(f"{dst}/rows/load={number}")
        batch.filter("_corrupt_record is not null").select("_corrupt_record").write.mode("overwrite").parquet(f"{dst}/bad/load={number}")
        batch.unpersist()

    q = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return q
