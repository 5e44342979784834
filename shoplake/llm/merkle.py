"""Merkle manifest of a table: leaves by row, a tree for each group of rows, and a tree over the groups' roots.

Trees grow level by level: indices within a group come from one global row number,
an index divided by the fanout names its parent, and the sorted children of a
parent are hashed into it. Every level is a written table of runs. Proofs go the
other way: runs are joined with what their parents have above them, so that a
node's siblings are put before its parent's, from the root down to the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplake.llm.store import written
from shoplake.operators.ranking import global_row_number

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "cast(array() as array<struct<l: string, r: string>>)"


def leaf(columns: list[Column]) -> Column:
    """H of the columns: ``-`` for a null, else the count of UTF-8 bytes, a colon and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``, an array of (l, r) from the leaf up."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x.l, h, x.r), 256))


def proof(path: Column) -> Column:
    """H of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x.l, x.r)), ""), 256)


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m.hash), "")


def _grow(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """``nodes`` (key, n, idx, hash, load), n of them with each key and at most ``most``, to the runs of each level and the roots (key, n, hash)."""
    runs, now = [], nodes
    roots = nodes.filter("n = 1").select("key", "n", "hash")
    while (width := fanout ** len(runs)) < most:
        members = F.sort_array(F.collect_list(F.struct("idx", "hash", *(["load"] if not runs else []))))
        run = written(now.filter(F.col("n") > width).groupBy("key", "n", F.floor(F.col("idx") / fanout).alias("parent")).agg(members.alias("members")), "merkle-level")
        runs.append(run)
        now = run.select("key", "n", F.col("parent").alias("idx"), F.sha2(_joined(F.col("members")), 256).alias("hash"))
        roots = roots.unionByName(now.filter(F.col("n") <= width * fanout).select("key", "n", "hash"))
    return runs, roots


def _descend(nodes: DataFrame, runs: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the path of each; ``tops`` (key, n, path, top) are the roots' own paths."""
    above = None
    for level in reversed(range(len(runs))):
        width = fanout**level
        enter = tops.filter((F.col("n") > width) & (F.col("n") <= width * fanout)).select("key", F.lit(0).cast("long").alias("parent"), "path", "top")
        above = enter if above is None else enter.unionByName(above.select("key", F.col("idx").alias("parent"), "path", "top"))
        each = runs[level].join(above, ["key", "parent"]).select("key", "members", "path", "top", F.posexplode("members").alias("at", "m"))
        left, right = F.slice("members", F.lit(1), F.col("at")), F.slice("members", F.col("at") + 2, F.lit(fanout))
        step = F.array(F.struct(_joined(left).alias("l"), _joined(right).alias("r")))
        above = each.select("key", "m.*", F.concat(step, "path").alias("path"), "top")
    lone = nodes.filter("n = 1").select("key", "idx", "hash", "load").join(tops.filter("n = 1").select("key", "path", "top"), "key")
    return lone if above is None else above.select("key", "idx", "hash", "load", "path", "top").unionByName(lone.select("key", "idx", "hash", "load", "path", "top"))


@dataclass(frozen=True)
class Manifest:
    """``root``; ``subroots`` (group, leaves, subroot); ``leaves``: a row of the table each, with leaf, subroot, path and ``load``."""

    root: str | None
    subroots: DataFrame
    leaves: DataFrame


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", load: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``docs``: ``columns`` make a leaf, leaves are ordered by ``order`` within a ``group``, groups by their UTF-8 bytes.

    ``load`` is a struct that a leaf's row keeps. Nulls come first in both orders;
    rows that have ``order`` in common are ordered by leaf, so that equal rows have
    one leaf twice. Null and empty values differ, very long ones are hashed whole. A table of one row
    is its own root, one of none has the root None and no rows. A group may hold
    nearly all rows: numbers come from ranges of the whole table, and runs, paths and joins go by index.
    """
    held = load if load is not None else F.struct(F.lit(None).cast("string").alias("none"))
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), F.col(order).alias("at"), leaf([F.col(c) for c in columns]).alias("hash"), held.alias("load"))
    numbered = global_row_number(rows, [F.asc_nulls_first("key"), F.asc_nulls_first("at"), F.asc("hash")], "number")
    groups = written(numbered.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")), "merkle-groups")
    nodes = numbered.join(groups, "key").select("key", "n", (F.col("number") - F.col("first")).alias("idx"), "hash", "load")
    most, many = groups.agg(F.max("n"), F.count("*")).first()
    runs, roots = _grow(nodes, most or 0, fanout)
    roots = written(roots, "merkle-subroots")
    upper = global_row_number(roots, [F.asc("key")], "number").select(F.lit("").alias("key"), F.lit(many).cast("long").alias("n"), (F.col("number") - 1).alias("idx"), "hash", F.struct(F.col("key").alias("group"), F.col("n").alias("leaves")).alias("load"))
    upper_runs, top = _grow(upper, many, fanout)
    found = top.first()
    tops = top.select("key", "n", F.expr(NO_PATH).alias("path"), F.lit(None).cast("string").alias("top"))
    subs = written(_descend(upper, upper_runs, tops, fanout).select(F.col("load.group").alias("key"), F.col("load.leaves").alias("n"), "path", F.col("hash").alias("top")), "merkle-tops")
    leaves = _descend(nodes, runs, subs, fanout)
    name = F.when(F.col("key") != "0", F.substring("key", 2, 1_000_000_000))
    return Manifest(found and found.hash, subs.select(name.alias("group"), F.col("n").alias("leaves"), F.col("top").alias("subroot")), leaves.select(F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "path", "load"))


def audit(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", changed: str = "text", change: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every row's proof, and what the root would be if rows for which ``tampered`` is true held ``change`` in the column ``changed`` (unset: its text with A-Z lower-cased).

    Columns: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified. A
    null ``tampered`` is false, a null value stays null. Other cases are those of ``build``; other columns of ``docs`` are ignored.
    """
    other = F.translate(F.col(changed).cast("string"), UPPER, LOWER) if change is None else change
    again = F.when(tampered, leaf([F.when(F.col(changed).isNotNull(), other) if c == changed else F.col(c) for c in columns]))
    load = F.struct(F.col(order).alias("id"), again.alias("again"))
    found = build(docs, columns, group, order, load, fanout)
    root = F.lit(found.root).cast("string")
    rows = found.leaves.select(F.col("load.id").alias(order), "leaf", "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("load.again", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
