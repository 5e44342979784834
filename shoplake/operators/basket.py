"""Co-purchase pairs: one engine for product affinity and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(items: DataFrame, order: str, item: str, min_count: int = 1, wide: int = 500, min_support: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs a < b with n, item counts, one row with n_orders); orders are counted once per item and pair.

    An item in fewer than ``min_count`` orders, or a lesser share of all orders than ``min_support``, can't be in a pair that reaches
    it, so it is dropped before pairs are made. Pairs are made inside each
    order's sorted array: one shuffle, no self-join. An order of more than
    ``wide`` items would make too many in one row; its items meet its array one
    by one, each in a row of its own.
    """
    rows = items.select(F.col(order).alias("o"), F.col(item).alias("i")).filter("o is not null and i is not null").distinct()
    singles = rows.groupBy("i").agg(F.count("*").alias("n"))
    orders = rows.agg(F.countDistinct("o").alias("n_orders"))
    often = singles.filter(F.col("n") >= min_count)
    if min_support > 0:
        often = often.crossJoin(F.broadcast(orders)).filter(F.col("n").cast("double") / F.col("n_orders").cast("double") >= min_support)  # one row of orders
    kept = rows.join(often.select("i"), "i", "left_semi") if min_count > 1 or min_support > 0 else rows
    baskets = kept.groupBy("o").agg(F.array_sort(F.collect_set("i")).alias("b")).filter(F.size("b") > 1)
    after = lambda x, k: F.transform(F.slice("b", k + 2, F.size("b")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    inside = F.flatten(F.transform("b", after)).alias("p")
    one_by_one = baskets.filter(F.size("b") > wide).select("b", F.posexplode("b").alias("k", "x")).repartition("x").select(F.explode(after(F.col("x"), F.col("k"))).alias("p"))
    made = baskets.filter(F.size("b") <= wide).select(F.explode(inside)).toDF("p").unionByName(one_by_one)
    pairs = made.groupBy("p.a", "p.b").agg(F.count("*").alias("n_pair"))
    return pairs, singles, orders


def _measured(pairs: DataFrame, singles: DataFrame, orders: DataFrame) -> DataFrame:
    a, b = singles.select(F.col("i").alias("a"), F.col("n").alias("n_a")), singles.select(F.col("i").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, "b").crossJoin(F.broadcast(orders))


def product_affinity(items: DataFrame, order: str = "order_id", item: str = "product_id", min_count: int = 3, min_lift: float = 1.0) -> DataFrame:
    """Pairs in at least ``min_count`` orders whose rounded lift exceeds ``min_lift``."""
    rows = _measured(*pair_counts(items, order, item, min_count)).filter(F.col("n_pair") >= min_count)
    n, na, nb, ab = (F.col(c).cast("double") for c in ("n_orders", "n_a", "n_b", "n_pair"))
    out = rows.select("a", "b", "n_pair", F.round(ab / n, 6).alias("support"), F.round(ab / na, 4).alias("confidence"), F.round(ab * n / (na * nb), 4).alias("lift"))
    return out.filter(F.col("lift") > min_lift)


def association_rules(items: DataFrame, order: str = "order_id", item: str = "product_id", min_support: float = 0.001, min_confidence: float = 0.1, min_lift: float = 1.0) -> DataFrame:
    """Rules in both directions, by baskets, without rounding."""
    rows = _measured(*pair_counts(items, order, item, min_support=min_support))
    n, na, nb, ab = (F.col(c).cast("double") for c in ("n_orders", "n_a", "n_b", "n_pair"))
    both = rows.select(F.explode(F.array(*[F.struct(F.col(x).alias("antecedent"), F.col(y).alias("consequent"), (ab / n).alias("support"), (ab / base).alias("confidence"), (ab * n / (na * nb)).alias("lift")) for x, y, base in (("a", "b", na), ("b", "a", nb))])).alias("r")).select("r.*")
    return both.filter((F.col("support") >= min_support) & (F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))
