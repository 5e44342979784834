"""File loads with a ledger: what was loaded, when, with how many rows and errors, and what replaces it when a load is forced.

A table's folder holds ``rows`` and ``bad`` by load, and ``ledger`` with a row per
file and load. A load writes rows first and its ledger rows last, so one that
breaks off leaves nothing that counts: readers take the loads that the ledger names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.sources.files import FORMATS, _exists, _nulls

LEDGER = "file string, size long, modified timestamp, load long, loaded_at timestamp, rows long, errors long, status string"


def read_ledger(spark: SparkSession, dst: str) -> DataFrame:
    """Every load of every file."""
    at = f"{dst}/ledger"
    return spark.read.schema(LEDGER).parquet(at) if _exists(spark, at) else spark.createDataFrame([], LEDGER)


def loaded_rows(spark: SparkSession, dst: str, kind: str = "rows") -> DataFrame:
    """Rows of each file's last load, with _source_file and load; ``kind`` "bad" gives the lines that didn't parse."""
    last = read_ledger(spark, dst).groupBy(F.col("file").alias("_source_file")).agg(F.max("load").alias("load"))
    return spark.read.parquet(f"{dst}/{kind}").withColumn("load", F.col("load").cast("long")).join(last, ["_source_file", "load"], "left_semi")


def load_files(spark: SparkSession, src: str, schema: str, dst: str, force: bool = False) -> DataFrame:
    """Load the CSV files of ``src`` that the ledger lacks, or has with another size or time; all with ``force``, whose rows replace earlier ones.

    Lines that don't parse go beside the rows and count as errors of their file;
    sources stay. Returns the ledger rows of this load, none if there was nothing to do. Status:
    LOADED, PARTIALLY_LOADED, LOAD_FAILED (no line parsed) or EMPTY.
    """
    there = spark.read.format("binaryFile").load(src).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter("size > 0")
    known = read_ledger(spark, dst)
    number = known.agg(F.coalesce(F.max("load") + 1, F.lit(0))).first()[0]
    # The names of files to read, which the reader needs on the driver anyway.
    wanted = (there if force else there.join(known, ["file", "size", "modified"], "left_anti")).collect()
    if not wanted:
        return spark.createDataFrame([], LEDGER)
    reader = spark.read.schema(schema + ", _corrupt_record string").options(header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **FORMATS)
    # Written once with both kinds, so that files are parsed once and counts are those of what was written.
    lines = reader.csv([r.file for r in wanted]).select("*", F.col("_metadata.file_path").alias("_source_file"))
    good = F.col("_corrupt_record").isNull()
    parsed = f"{dst}/parsed/load={number}"
    lines.write.mode("overwrite").parquet(parsed)
    back = spark.read.schema(lines.schema).parquet(parsed)
    _nulls(back.filter(good).drop("_corrupt_record")).write.mode("overwrite").parquet(f"{dst}/rows/load={number}")
    back.filter(~good).select("_corrupt_record", "_source_file").write.mode("overwrite").parquet(f"{dst}/bad/load={number}")
    counts = back.groupBy(F.col("_source_file").alias("file")).agg(F.sum(good.cast("long")).alias("rows"), F.sum((~good).cast("long")).alias("errors"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    status = F.when(z("rows") + z("errors") == 0, "EMPTY").when(z("errors") == 0, "LOADED").when(z("rows") == 0, "LOAD_FAILED").otherwise("PARTIALLY_LOADED")
    done = spark.createDataFrame([(r.file, r.size, r.modified) for r in wanted], "file string, size long, modified timestamp").join(counts, "file", "left")
    done = done.select("file", "size", "modified", F.lit(number).cast("long").alias("load"), F.current_timestamp().alias("loaded_at"), z("rows").alias("rows"), z("errors").alias("errors"), status.alias("status"))
    done.coalesce(1).write.mode("append").parquet(f"{dst}/ledger")
    return read_ledger(spark, dst).filter(F.col("load") == number)
