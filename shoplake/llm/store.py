"""Tables that cut lineage: the library's own store, and what only the corpus half needs of it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.functions.store import new_path, shared_folder, written

__all__ = ["arrow_rows", "new_path", "numbered", "shared_folder", "written"]


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` as a written table (node, whole): a number and the row as a struct, so that columns of any name are kept.

    Numbers are made in the pass that writes them. Those made anew at every read
    depend on how files are split, which changes with the number of cores.
    """
    return written(docs.select(F.monotonically_increasing_id().alias("node"), F.struct("*").alias("whole")), label)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, Arrow batches have ``most`` rows at most; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
