"""Documents to packed training sequences: five stages, each a function of (spark, docs, sf_dir).

The four filters return rows of ``docs`` with all their columns, whatever those
are named, and never an altered one. Null and empty texts are dropped by the
quality rules; the stages alone treat a null text as an empty one. Very long texts
are read whole. Rows are told apart by numbers written with them, so null
and repeated ids are no special case: repeated rows stay or go together, but for
near-dedup, which keeps the first. An empty table stays empty. What a stage asks of
the session it takes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplake.llm import decontam, nearcopies, packing, quality, toxicity
from shoplake.llm.queries import table, toxicity_model
from shoplake.llm.store import arrow_rows, written


#: Rows of an Arrow batch. Texts are long, so that a batch of Spark's default of 10,000 takes much of a worker's memory.
BATCH_ROWS = 2_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with toxic passages go; labels are learnt as in op5, from those of ``docs`` that have one."""
    with arrow_rows(spark, BATCH_ROWS):
        return written(toxicity.civil(docs, toxicity_model(docs, table(spark, sf_dir, "labels"))), "stage-civil")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the threshold table go."""
    return quality.good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose 5-word shingles have a Jaccard similarity of 0.8 or more: SimHash in the trie join, then an exact join for pairs beyond its bits."""
    with arrow_rows(spark, BATCH_ROWS):
        table(spark, sf_dir, "documents")  # ships the package when this stage runs alone
        return nearcopies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, some words of which may be others, go."""
    with arrow_rows(spark, BATCH_ROWS):
        return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into windows that keep the mixture of sources; one row per piece."""
    with arrow_rows(spark, BATCH_ROWS):
        table(spark, sf_dir, "documents")
        return written(packing.pack(docs), "stage-pieces")


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Models, fingerprints and subword ids have no SQL form; tests/llm/test_pipeline.py checks stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
