"""The whole recommender as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoplake.functions.store import written
from shoplake.operators.basket import association_rules
from shoplake.recs import factors, hybrid
from shoplake.sources.files import write_csv, write_parquet


def recommend_all(items: DataFrame, orders: DataFrame, reviews: DataFrame, products: DataFrame, min_support: float = 0.0005, n: int = 10, history_order: str = "recent") -> tuple[DataFrame, DataFrame]:
    """(top ``n`` for every customer with interactions, association rules)."""
    inter = written(hybrid.interactions(items, orders, reviews), "interactions")
    vectors = hybrid.tfidf(hybrid.product_tokens(products), products)
    rules = association_rules(items, min_support=min_support)
    model = factors.train_cf(inter)
    cart = hybrid.history(inter, 3, history_order)
    picks = hybrid.hybrid_recs(factors.cf_top_n(model, inter), hybrid.content_recs(inter, vectors, order=history_order), hybrid.rule_recs(cart, rules), hybrid.popularity(inter, products), inter, products, n=n)
    return picks, rules


def write_recommendations(picks: DataFrame, rules: DataFrame, dst: str) -> None:
    """The recommendation marts: picks as a table and as CSV, rules as CSV, strongest first within each part."""
    write_parquet(picks, f"{dst}/recommendations")
    write_csv(picks, f"{dst}/recommendations_csv")
    write_csv(rules.sortWithinPartitions(rules["lift"].desc(), "antecedent", "consequent"), f"{dst}/association_rules_csv")
