"""Exact top lists by blocked products: every query vector against all items, a bounded block of items at a time.

Pairs of queries and items are never rows: a task scores an Arrow batch of
queries against one broadcast block in numpy and sends on the best ``n`` of each.
Memory is that of one block and one batch, whatever the sizes of both tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.store import written

#: Items of one broadcast block.
BLOCK_ITEMS = 200_000


def top(df: DataFrame, keys: list[str], score: str, item: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def in_blocks(kinds: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[pd.DataFrame]:
    """``kinds`` (kind, tokens, weights, members), a row for equal vectors, in blocks of about ``block_items`` rows and 8 times as many members; one is in memory at a time."""
    rows, members = kinds.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
    blocks = max(1, -(-rows // block_items), -(-members // (8 * block_items)))
    for b in range(blocks):
        yield kinds.filter(F.pmod(F.xxhash64("kind"), F.lit(blocks)) == b).select("tokens", "weights", "members").toArrow().to_pandas()


def best_of_blocks(queries: DataFrame, key: str, blocks: Iterator[tuple], rank: Callable, schema: str, score: str, item: str, n: int) -> DataFrame:
    """``rank(batches, block)`` over ``queries`` for each block, the best ``n`` per ``key`` kept from block to block.

    Each block's list is written before the next block is made, so one broadcast
    is alive at a time and no list grows beyond ``n`` per query.
    """
    spark, best = queries.sparkSession, None
    for block in blocks:
        handle = spark.sparkContext.broadcast(block)
        part = queries.mapInPandas(lambda it, h=handle: rank(it, h.value), schema)
        best = written(part if best is None else top(best.unionByName(part), [key], score, item, n), "best")
        handle.unpersist()
    return best


class Inverted:
    """A block of items with sparse vectors: equal vectors are one signature, found by token."""

    def __init__(self, rows: pd.DataFrame):
        self.size = len(rows)
        many = np.array([len(m) for m in rows["members"]], dtype=np.int64)
        ids = np.concatenate(rows["members"].tolist()) if len(rows) else np.empty(0, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        sig = np.repeat(np.arange(self.size), many)[order]
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for i, (tokens, weights) in enumerate(zip(rows["tokens"], rows["weights"])):
            for t, w in zip(tokens, weights):
                at = lists.setdefault(t, ([], []))
                at[0].append(i)
                at[1].append(w)
        self.lists = {t: (np.array(s, dtype=np.int64), np.array(w)) for t, (s, w) in lists.items()}
        self.members = np.argsort(sig, kind="stable")  # by signature, then by place, which is the order of ids
        self.starts = np.searchsorted(sig[self.members], np.arange(self.size + 1))

    def places(self, ids) -> set[int]:
        """Places of those of ``ids`` that are here."""
        if not len(ids) or not len(self.ids):
            return set()
        ids = np.asarray(ids)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return set(at[self.ids[at] == ids].tolist())

    def best(self, tokens, weights, have, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``n`` best items with a positive score that aren't in ``have``; ties by place."""
        scores = np.zeros(self.size)
        for t, w in zip(tokens, weights):
            if t in self.lists:
                at, other = self.lists[t]
                scores[at] += w * other
        scores = np.round(scores, 9)
        gone = self.places(have)
        live = np.flatnonzero(scores > 0)
        enough = n + len(gone)
        if len(live) > enough:  # as many signatures have enough members, whichever were bought; equal scores all stay
            cut = np.partition(scores[live], len(live) - enough)[len(live) - enough]
            live = live[scores[live] >= cut]
        live = live[np.argsort(-scores[live], kind="stable")]
        found, values = [], []
        for level in np.split(live, np.flatnonzero(np.diff(scores[live])) + 1) if len(live) else []:
            # Of each signature no more members than are still asked for can matter.
            most = n - len(found) + len(gone)
            places = np.sort(np.concatenate([self.members[self.starts[s] : self.starts[s + 1]][:most] for s in level.tolist()]))
            places = [p for p in places.tolist() if p not in gone][: n - len(found)]
            found += places
            values += [scores[level[0]]] * len(places)
            if len(found) >= n:
                break
        return np.array(found, dtype=np.int64), np.array(values)


def nearest(queries: DataFrame, key: str, vectors: DataFrame, item: str, n: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, item, score): for each query (key, tokens, weights, have) the ``n`` items of greatest positive dot product, not in ``have``.

    ``vectors``: (item, token, weight). Scores are rounded to nine digits, ties go to the smaller item.
    """
    bags = vectors.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("v")).withColumn("kind", F.transform("v", lambda x: F.struct(x["token"], F.round(x["weight"], 9))))
    # Of equal vectors only the first n + bought can be in a list, so many at most are kept; each kind is in one block.
    most = queries.agg(F.coalesce(F.max(F.size("have")), F.lit(0))).first()[0]
    first = bags.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(item))).filter(F.col("_n") <= n + most)
    kinds = first.groupBy("kind").agg(F.min_by("v", item).alias("v"), F.collect_list(item).alias("members")).select("kind", F.col("v.token").alias("tokens"), F.col("v.weight").alias("weights"), "members")
    kinds = written(kinds, "vectors")
    schema = f"{key} {queries.schema[key].dataType.simpleString()}, {item} {vectors.schema[item].dataType.simpleString()}, score double"

    def rank(batches: Iterator[pd.DataFrame], block: Inverted) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids, scores = [], [], []
            for k, tokens, weights, have in zip(batch[key], batch["tokens"], batch["weights"], batch["have"]):
                places, values = block.best(tokens, weights, have, n)
                keys += [k] * len(places)
                ids.append(block.ids[places])
                scores.append(values)
            yield pd.DataFrame({key: keys, item: np.concatenate(ids) if ids else [], "score": np.concatenate(scores) if scores else []})

    return best_of_blocks(queries, key, map(Inverted, in_blocks(kinds, block_items)), rank, schema, "score", item, n)
