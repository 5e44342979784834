"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.store import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (u, v) to (u, component), the smallest node reachable; nodes that are their own component are left out.

    Groups by node only for a minimum, which is combined before the shuffle, and
    joins that back, so a node with very many edges can be split. Every round is
    a written table, so lineage stays short and a lost executor costs a re-read.
    """
    stars = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
    seen = _state(stars)
    if not seen[0]:
        return stars.select("u", F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        stars = written(small, "components")
        if (now := _state(stars)) == seen:
            return stars.select("u", F.col("v").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
