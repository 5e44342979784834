"""Hybrid recommendations: interactions, content, rules, popularity and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.cluster import broadcast_if_small
from shoplake.functions.store import written
from shoplake.operators.ranking import global_row_number
from shoplake.recs.blocks import BLOCK_ITEMS, nearest, top


def interactions(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """(customer, product) with quantity, mean rating (3 where unrated) and score; cancelled orders count."""
    per = items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("q"))
    bought = per.join(orders.select("order_id", "customer_id", "order_date"), "order_id").filter("customer_id is not null")
    sums = bought.groupBy("customer_id", "product_id").agg(F.sum("q").alias("quantity"), F.max("order_date").alias("last_date"))
    rated = reviews.groupBy("customer_id", "product_id").agg(F.avg("rating").alias("r"))
    rating = F.coalesce("r", F.lit(3.0))
    return sums.join(rated, ["customer_id", "product_id"], "left").select("customer_id", "product_id", "quantity", rating.alias("rating"), F.round(F.col("quantity") * (1 + F.log1p(rating)), 4).alias("score"), "last_date")


def popularity(inter: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Score sum per product over the greatest sum; with ``products``, 0 for those never bought."""
    sums = inter.groupBy("product_id").agg(F.sum("score").alias("s"))
    best = F.broadcast(sums.agg(F.max("s").alias("best")))
    if products is not None:
        sums = products.select("product_id").join(sums, "product_id", "left")
    return sums.crossJoin(best).select("product_id", F.coalesce(F.col("s") / F.col("best"), F.lit(0.0)).alias("popularity"))


def product_tokens(products: DataFrame, columns: tuple[str, ...] = ("product_name", "category_name", "brand")) -> DataFrame:
    """(product_id, token, n): lower-cased words of more than two characters; missing values are empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    words = products.select("product_id", F.explode(F.split(text, "\\s+")).alias("token")).filter(F.length("token") > 2)
    return words.groupBy("product_id", "token").agg(F.count("*").alias("n"))


def tfidf(tokens: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, token, weight), L2-normalised. tf over all tokens of a product, idf = ln((N + 1) / (df + 1)) + 1, vocabulary: two occurrences at least."""
    size = tokens.groupBy("product_id").agg(F.sum("n").alias("all"))
    vocabulary = tokens.groupBy("token").agg(F.sum("n").alias("c"), F.count("*").alias("df")).filter("c >= 2")
    total = F.broadcast(products.agg(F.count("*").alias("products")))
    w = tokens.join(vocabulary, "token").join(size, "product_id").crossJoin(total).select("product_id", "token", (F.col("n") / F.col("all") * (F.log((F.col("products") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = w.groupBy("product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "product_id").select("product_id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def similar_products(vectors: DataFrame, n: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Cosine top n without the product itself. Products with equal vectors ask once; every query meets all items in blocks, no pair is a row."""
    rows = vectors.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("v"))
    bags = written(rows.withColumn("sig", F.xxhash64(F.transform("v", lambda x: F.struct(x["token"], F.round(x["weight"], 9))))), "bags")
    asked = bags.groupBy("sig").agg(F.min_by("v", "product_id").alias("v")).select("sig", F.col("v.token").alias("tokens"), F.col("v.weight").alias("weights"), F.array().cast("array<long>").alias("have"))
    near = nearest(asked, "sig", vectors, "product_id", n + 1, block_items).withColumnRenamed("product_id", "other_id")
    pairs = bags.select("product_id", "sig").join(near, "sig").filter("other_id <> product_id").select("product_id", "other_id", F.col("score").alias("similarity"))
    return top(pairs, ["product_id"], "similarity", "other_id", n)


def history(inter: DataFrame, last: int, order: str = "recent") -> DataFrame:
    """The last products of each customer: by date, or by product id as the original has it."""
    by = [F.desc("last_date"), F.desc("product_id")] if order == "recent" else [F.desc("product_id")]
    w = Window.partitionBy("customer_id").orderBy(*by)
    return inter.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last).select("customer_id", "product_id")


def content_recs(inter: DataFrame, vectors: DataFrame, last: int = 10, n: int = 50, order: str = "recent", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Products nearest to the mean of the last ``last`` product vectors that the customer hasn't bought; exact, every customer against all products in blocks."""
    hist = history(inter, last, order).join(vectors.select("product_id").distinct(), "product_id", "left_semi")
    size = hist.groupBy("customer_id").agg(F.count("*").alias("k"))
    mean = hist.join(vectors, "product_id").groupBy("customer_id", "token").agg(F.sum("weight").alias("s")).join(size, "customer_id")
    asked = mean.groupBy("customer_id").agg(F.collect_list(F.struct("token", (F.col("s") / F.col("k")).alias("weight"))).alias("v"))
    have = inter.groupBy("customer_id").agg(F.collect_set("product_id").alias("have"))
    queries = written(asked.join(have, "customer_id").select("customer_id", F.col("v.token").alias("tokens"), F.col("v.weight").alias("weights"), "have"), "content-queries")
    return nearest(queries, "customer_id", vectors, "product_id", n, block_items)


def rule_recs(cart: DataFrame, rules: DataFrame, n: int = 30) -> DataFrame:
    """Consequents of rules whose antecedent is in the cart; bought products keep their places and go in the blend."""
    hits = cart.join(rules.select(F.col("antecedent").alias("product_id"), "consequent", (F.col("lift") * F.col("confidence")).alias("s")), "product_id")
    rows = hits.select("customer_id", F.col("consequent").alias("product_id"), "s").join(cart, ["customer_id", "product_id"], "left_anti").groupBy("customer_id", "product_id").agg(F.max("s").alias("score"))
    return top(rows, ["customer_id"], "score", "product_id", n)


def normalize(scores: DataFrame) -> DataFrame:
    """Scores over the customer's greatest; 0 where that isn't positive."""
    best = F.max("score").over(Window.partitionBy("customer_id"))
    return scores.withColumn("_b", best).withColumn("score", F.when(F.col("_b") > 0, F.col("score") / F.col("_b")).otherwise(0.0)).drop("_b")


#: Reasons by the part that speaks first, and the one for none.
REASONS = ("Based on customers like you", "Similar to items you bought", "Frequently bought together", "Trending in your category")


def hybrid_recs(cf: DataFrame, content: DataFrame, rules: DataFrame, pop: DataFrame, inter: DataFrame, products: DataFrame, weights: tuple[float, ...] = (0.5, 0.3, 0.15, 0.05), n: int = 10) -> DataFrame:
    """Weighted blend over all products a customer hasn't bought, exact without scoring all pairs.

    A product in none of the three lists scores by popularity alone, so of those
    only the most popular n + bought + listed can matter to a customer.
    """
    parts = [normalize(s).select("customer_id", "product_id", *[(F.col("score") if i == k else F.lit(0.0)).alias(f"p{i}") for i in range(3)]) for k, s in enumerate((cf, content, rules))]
    listed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("customer_id", "product_id").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(3)])
    bought = inter.select("customer_id", "product_id")
    need = bought.unionByName(listed.select("customer_id", "product_id")).groupBy("customer_id").agg((F.count("*") + n).alias("m"))
    need = written(need, "needs")
    popular = pop.select("product_id", F.round(F.lit(weights[3]) * F.col("popularity"), 6).alias("part"))
    most = need.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    order = global_row_number(popular, [F.desc("part"), F.col("product_id")], "place").filter(F.col("place") <= most).select(F.col("place").cast("long").alias("place"), "product_id")
    # A heavy buyer lengthens only their own slice of the popular list. Place 1 is in every slice, so the list is broadcast as long as it is short.
    slices = need.select("customer_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("place")).join(broadcast_if_small(order, 1_000_000), "place").select("customer_id", "product_id", *[F.lit(0.0).alias(f"p{i}") for i in range(3)])
    rows = listed.unionByName(slices).groupBy("customer_id", "product_id").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(3)])
    rows = rows.join(bought, ["customer_id", "product_id"], "left_anti").join(pop, "product_id")
    score = F.round(sum((F.lit(w) * F.col(c) for w, c in zip(weights, ("p0", "p1", "p2", "popularity"))), F.lit(0.0)), 6)
    reason: Column = F.coalesce(*[F.when(F.col(f"p{i}") > 0.3, F.lit(text)) for i, text in enumerate(REASONS[:3])], F.lit(REASONS[3]))
    scored = rows.select("customer_id", "product_id", score.alias("score"), reason.alias("reason"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("score"), "product_id")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    named = best.join(products.select("product_id", "product_name", "category_name"), "product_id", "left")
    return named.select("customer_id", "product_id", F.coalesce("product_name", F.lit("Unknown")).alias("product_name"), F.coalesce("category_name", F.lit("")).alias("category_name"), "score", "rank", "reason", F.lit("hybrid_v1").alias("algorithm"))


def user_item_scores(**lists: DataFrame) -> DataFrame:
    """One long table of scores by algorithm."""
    out = None
    for name, df in lists.items():
        part = df.select("customer_id", "product_id", F.col("score").cast("double").alias("score"), F.lit("v1").alias("model_version"), F.lit(name).alias("algorithm"))
        out = part if out is None else out.unionByName(part)
    return out
