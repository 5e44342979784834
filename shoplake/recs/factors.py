"""Matrix factorization of capped interaction scores and its top lists."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.store import written
from shoplake.operators.ranking import global_row_number
from shoplake.recs.blocks import BLOCK_ITEMS, top


class Factors(NamedTuple):
    model: ALSModel
    users: DataFrame  # customer_id, u
    items: DataFrame  # product_id, i


def _ids(df: DataFrame, key: str, name: str) -> DataFrame:
    rows = global_row_number(df.select(key).distinct(), [F.col(key)], name)
    return rows.select(key, (F.col(name) - 1).cast("int").alias(name))


def train_cf(inter: DataFrame, rank: int = 15, iterations: int = 10, reg: float = 0.1, cap: float = 5.0) -> Factors:
    users, items = written(_ids(inter, "customer_id", "u"), "cf-users"), written(_ids(inter, "product_id", "i"), "cf-items")
    rows = inter.join(users, "customer_id").join(items, "product_id").select("u", "i", F.least("score", F.lit(cap)).cast("float").alias("score"))
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="u", itemCol="i", ratingCol="score", coldStartStrategy="drop", seed=42)
    return Factors(als.fit(rows), users, items)


def rmse(rows: DataFrame) -> DataFrame:
    """Of (score, prediction)."""
    return rows.agg(F.sqrt(F.avg((F.col("prediction") - F.col("score")) ** 2)).alias("rmse"))


def cf_rmse(f: Factors, inter: DataFrame, cap: float = 5.0) -> DataFrame:
    rows = inter.join(f.users, "customer_id").join(f.items, "product_id").select("u", "i", F.least("score", F.lit(cap)).alias("score"))
    return rmse(f.model.transform(rows))


def cf_top_n(f: Factors, inter: DataFrame, n: int = 50, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Unbought products by factor product; customers and products without factors have none."""
    items = f.model.itemFactors.join(f.items.withColumnRenamed("i", "id"), "id").select("product_id", "features")
    users = f.model.userFactors.join(f.users.withColumnRenamed("u", "id"), "id").select("customer_id", "features")
    return top_by_factors(users, items, inter, n, block_items)


class Cells(NamedTuple):
    """Items in cells of near vectors, each cell together, with what bounds a product in it: centre and radius, longest vector."""

    ids: np.ndarray
    by_id: np.ndarray  # an item's place in the order of ids
    sorted_at: np.ndarray  # places of items in the order of ids
    matrix: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray


def cells(ids: np.ndarray, matrix: np.ndarray, size: int = 1024, most: int = 256, rounds: int = 3) -> Cells:
    """Cells of about ``size`` items, ``most`` of them at most: k-means, whose result decides on time only, as the bounds are taken from the cells that it gives."""
    k = max(1, min(most, -(-len(ids) // size)))
    cell = np.zeros(len(ids), dtype=np.int64)
    if k > 1:
        centres = matrix[np.sort(np.random.default_rng(42).choice(len(ids), k, replace=False))].astype(np.float32)
        for _ in range(rounds):
            for lo in range(0, len(ids), 16384):
                cell[lo : lo + 16384] = np.argmin((centres * centres).sum(axis=1) - 2 * (matrix[lo : lo + 16384] @ centres.T), axis=1)
            many = np.maximum(np.bincount(cell, minlength=k), 1)
            centres = np.stack([np.bincount(cell, weights=matrix[:, d], minlength=k) / many for d in range(matrix.shape[1])], axis=1).astype(np.float32)
    order = np.argsort(cell, kind="stable")
    ids, matrix, cell = ids[order], matrix[order], cell[order]
    starts = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
    which, wide = np.cumsum(np.r_[False, np.diff(cell) != 0]), matrix.astype(np.float64)
    centres = np.add.reduceat(wide, starts, axis=0) / np.diff(np.r_[starts, len(ids)])[:, None]
    radius = np.maximum.reduceat(np.linalg.norm(wide - centres[which], axis=1), starts)
    longest = np.maximum.reduceat(np.linalg.norm(wide, axis=1), starts)
    sorted_at = np.argsort(ids, kind="stable")
    by_id = np.empty(len(ids), dtype=np.int64)
    by_id[sorted_at] = np.arange(len(ids))
    return Cells(ids, by_id, sorted_at, matrix, np.r_[starts, len(ids)], centres, radius, longest)


def _falling(value: np.ndarray) -> np.ndarray:
    """Floats as whole numbers of 32 bits in falling order."""
    bits = value.view(np.uint32)
    return (~(bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000)))).astype(np.uint64)


def _risen(key: np.ndarray) -> np.ndarray:
    """Floats of what ``_falling`` has made of them, in the lower 32 bits."""
    bits = ~(key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return (bits ^ np.where(bits >> np.uint32(31), np.uint32(0x80000000), np.uint32(0xFFFFFFFF))).view(np.float32)


def scan_cells(users: np.ndarray, gone: tuple[np.ndarray, np.ndarray], held: Cells, n: int, least: np.ndarray | None = None, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best ``n`` of the items for each user: (user's row, place of the item, score), ties to the smaller id; and how many pairs were scored.

    ``gone``: (user's row, id) pairs that are left out; ``least``: scores that a user's items have to reach.
    A product in a cell is at most that with its centre and the product of the user's length and the cell's radius,
    and at most that of the user's and the cell's greatest length, so cells that can't reach a user's n-th score are not scored.
    """
    mine = np.linalg.norm(users.astype(np.float64), axis=1)
    bound = np.minimum(users @ held.centres.T + mine[:, None] * held.radius, mine[:, None] * held.longest)
    bound += 1e-5 * mine[:, None] * held.longest + 1e-9
    gone_row, gone_id = gone
    at = np.minimum(np.searchsorted(held.ids[held.sorted_at], gone_id), len(held.ids) - 1) if len(gone_id) else np.empty(0, dtype=np.int64)
    at = held.sorted_at[at]
    there = held.ids[at] == gone_id
    order = np.argsort(at[there], kind="stable")
    gone_at, gone_row = at[there][order], gone_row[there][order]
    nth = np.full(len(users), -np.inf, dtype=np.float32) if least is None else least.astype(np.float32)
    rows, items, values, waiting, scored = [], [], [], 0, 0
    row_of = np.full(len(users), -1)

    def first_of_each(row: np.ndarray, item: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((held.by_id[item], -value, row))
        row = row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < n
        return row[kept], item[order][kept], value[order][kept]

    def settle() -> None:
        """Raises the n-th scores to those of what was found, and keeps what reaches them."""
        nonlocal rows, items, values, waiting
        row, item, value = (np.concatenate(x) for x in (rows, items, values))
        key = np.sort((row.astype(np.uint64) << np.uint64(32)) | _falling(value))  # by row, greatest score first
        last = np.searchsorted(key, np.arange(len(users)).astype(np.uint64) << np.uint64(32)) + n - 1
        full = np.flatnonzero(last < len(key))
        full = full[key[last[full]] >> np.uint64(32) == full.astype(np.uint64)]
        nth[full] = np.maximum(nth[full], _risen(key[last[full]]))
        near = np.flatnonzero(value >= nth[row])
        row, item, value = row[near], item[near], value[near]
        if len(row) > 2 * n * len(users):  # equal scores
            row, item, value = first_of_each(row, item, value)
        rows, items, values, waiting = [row], [item], [value], 0

    def visit(g: int, who: np.ndarray) -> None:
        nonlocal waiting, scored
        for lo in range(held.starts[g], held.starts[g + 1], chunk):
            part = held.matrix[lo : min(lo + chunk, held.starts[g + 1])]
            for some in np.split(who, range(1024, len(who), 1024)):
                some = some[bound[some, g] >= nth[some]]
                if not len(some):
                    continue
                scores = users[some] @ part.T
                scored += scores.size
                a, b = np.searchsorted(gone_at, (lo, lo + len(part)))
                if a < b:
                    row_of[some] = np.arange(len(some))
                    r = row_of[gone_row[a:b]]
                    scores[r[r >= 0], gone_at[a:b][r >= 0] - lo] = -np.inf
                    row_of[some] = -1
                fresh = np.flatnonzero(np.isneginf(nth[some]))
                if len(fresh) and len(part) > n:  # as many of this cell are as good as its n-th
                    nth[some[fresh]] = np.partition(scores[fresh], len(part) - n, axis=1)[:, len(part) - n]
                hit = np.flatnonzero(scores >= nth[some][:, None])
                value = scores.ravel()[hit]
                hit, value = (hit, value) if np.isfinite(value).all() else (hit[np.isfinite(value)], value[np.isfinite(value)])
                r, c = np.divmod(hit, len(part))
                rows.append(some[r])
                items.append(lo + c)
                values.append(value)
                waiting += len(hit)
                if waiting > max(100_000, n * len(users)):
                    settle()

    # First each user's best cells, which give a score to beat; then all that can still reach it.
    near = min(4, bound.shape[1])
    best = np.argpartition(-bound, near - 1, axis=1)[:, :near]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(bound, best, axis=1), axis=1, kind="stable"), axis=1)
    for rank in range(near):
        order = np.argsort(best[:, rank], kind="stable")
        for who in np.split(order, np.flatnonzero(np.diff(best[order, rank])) + 1):
            if len(who):
                visit(best[who[0], rank], who)
        if rows:
            settle()
    left = np.ones(bound.shape, dtype=bool)
    np.put_along_axis(left, best, False, axis=1)
    for g in np.argsort(-bound.max(axis=0), kind="stable").tolist() if len(users) else []:
        visit(g, np.flatnonzero(left[:, g] & (bound[:, g] >= nth)))
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), scored
    settle()
    return *first_of_each(rows[0], items[0], values[0]), scored


def scan(users: np.ndarray, have: list, ids: np.ndarray, matrix: np.ndarray, n: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``scan_cells`` over cells of an eighth of ``chunk`` items or so, with ids for places."""
    held = cells(ids, matrix, max(min(chunk, 8), chunk // 8), most=max(1, len(ids)))
    bought = [(r, x) for r, xs in enumerate(have) for x in xs]
    gone = tuple(np.array(x) for x in zip(*bought)) if bought else (np.empty(0, dtype=np.int64), ids[:0])
    row, item, value, scored = scan_cells(users, gone, held, n, chunk=chunk)
    return row, held.ids[item], value, scored


def _table(rows: DataFrame) -> pa.Table:
    """``rows`` in the driver as Arrow columns, which take a few bytes a number."""
    return rows.toArrow().combine_chunks()


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)


def top_by_factors(users: DataFrame, items: DataFrame, inter: DataFrame, n: int = 50, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``n`` products of greatest factor product that a customer hasn't bought, ties to the smaller id.

    ``users`` (customer_id, features), ``items`` (product_id, features). Exact.
    Items go by the length of their vectors, ``block_items`` broadcast at a time, in cells of near vectors; a
    customer takes part in a block only while its longest vector could still change the list, and in a cell likewise.
    Of items with one vector only the first n + bought can be in a list, ``bought`` the most products of a customer.
    """
    spark = users.sparkSession
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bought = inter.groupBy("customer_id").agg(F.collect_list("product_id").alias("have"))
    users = written(users.join(bought, "customer_id").withColumn("length", length(F.col("features"))), "users")
    most = users.agg(F.coalesce(F.max(F.size("have")), F.lit(0))).first()[0]
    alike = Window.partitionBy("features").orderBy("product_id")
    items = items.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= n + most).drop("_n")
    ranked = written(global_row_number(items.withColumn("length", length(F.col("features"))), [F.desc("length"), F.asc("product_id")], "place"), "item-factors")
    kind = lambda c: inter.schema[c].dataType.simpleString()
    schema = f"customer_id {kind('customer_id')}, product_id {kind('product_id')}, score double"

    def rank(batches: Iterator[pa.RecordBatch], block: Cells) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_500):
                part = whole.slice(lo, 2_500)
                customers, features, have, least = (part.column(c) for c in ("customer_id", "features", "have", "least"))
                gone = np.repeat(np.arange(len(have)), np.diff(have.offsets.to_numpy())), have.flatten().to_numpy(zero_copy_only=False)
                row, item, value, _ = scan_cells(_matrix(features), gone, block, n, least.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([customers.take(pa.array(row)), pa.array(block.ids[item], type=have.type.value_type), pa.array(value.astype(float))], names=["customer_id", "product_id", "score"])

    best, total = None, ranked.count()
    for begin in range(0, total, block_items):
        rows = _table(ranked.filter(F.col("place").between(begin + 1, begin + block_items)).orderBy("place").select("product_id", "features", "length"))
        longest = rows["length"][0].as_py()
        handle = spark.sparkContext.broadcast(cells(rows["product_id"].to_numpy(), _matrix(rows["features"].combine_chunks())))
        asked = users.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            done = best.groupBy("customer_id").agg(F.count("*").alias("listed"), F.min("score").alias("nth"))
            least = F.when(F.col("listed") >= n, F.col("nth")).otherwise(F.lit(float("-inf")))
            asked = users.join(done, "customer_id", "left").withColumn("least", F.coalesce(least, F.lit(float("-inf")))).filter(F.col("least") <= F.col("length") * longest * (1 + 1e-5) + 1e-9)
        part = asked.select("customer_id", "features", "have", "least").mapInArrow(lambda it, h=handle: rank(it, h.value), schema)
        best = written(part if best is None else top(best.unionByName(part), ["customer_id"], "score", "product_id", n), "best")
        handle.unpersist()
    return spark.createDataFrame([], schema) if best is None else best
