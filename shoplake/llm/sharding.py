"""Hierarchical weighted hash tree: region, rack and shard by weighted draws.

A child of weight w draws -ln(u) / w with u hashed from the document and the
child's own path, and the least draw wins: each is chosen in proportion to the
weight of its subtree. A document's way down takes one such race a level: among
regions, among the racks of its region, among the shards of its rack.

A weight that changes alters the draws on its own path and no other, so
documents move only into or out of that subtree. Shards added later are a
generation with a tree of their own. By the same law the least draw of a whole
generation is one draw with its summed weight, whichever leaf it falls on, so a
document meets one draw for each generation and moves only if a newer one is
below all older: into the new shards alone, wherever in the tree they stand.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.llm.store import written


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    generation: int = 0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards 0..n-1 of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region, all of one generation."""
    return [Leaf(i // (per_rack * racks), i // per_rack, i) for i in range(shards)]


def grown(tree: list[Leaf], region: int, rack: int, shard: int, weight: float = 1.0) -> list[Leaf]:
    """``tree`` with one more shard in a new or an old rack, or with more weight for an old one; it takes documents only into that shard."""
    return [*tree, Leaf(region, rack, shard, weight, 1 + max((x.generation for x in tree), default=-1))]


def _draw(key: Column, path: Column, weight: Column) -> Column:
    bits = F.xxhash64(key, path).bitwiseAND(F.lit((1 << 53) - 1))
    return -F.log((bits + 1) / F.lit(float(1 << 53))) / weight


def _children(children: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(n).alias("node")) for p, w, n in children])


def _race(key: Column, children: Column) -> Column:
    """The node with the least draw; an array of structs is compared by its first field, the draw."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["node"].alias("node"))))["node"]


def _descend(key: Column, leaves: list[tuple[int, Leaf]]) -> Column:
    """Place in the tree of the leaf that ``key`` comes to among ``leaves`` (place, leaf): three races along one path."""
    generation = leaves[0][1].generation
    regions = sorted({x.region for _, x in leaves})
    racks = sorted({(x.region, x.rack) for _, x in leaves})
    weight = lambda keep: sum(x.weight for _, x in leaves if keep(x))
    in_region = [_children([(f"{generation}/{r}/{k}", weight(lambda x, r=r, k=k: (x.region, x.rack) == (r, k)), i) for i, (q, k) in enumerate(racks) if q == r]) for r in regions]
    in_rack = [_children([(f"{generation}/{r}/{k}/{x.shard}", x.weight, place) for place, x in leaves if (x.region, x.rack) == (r, k)]) for r, k in racks]
    region = _race(key, _children([(f"{generation}/{r}", weight(lambda x, r=r: x.region == r), i) for i, r in enumerate(regions)]))
    rack = _race(key, F.element_at(F.array(*in_region), region + 1))
    return _race(key, F.element_at(F.array(*in_rack), rack + 1))


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The place in ``tree`` of the leaf that ``key`` comes to."""
    place, least = None, None
    for g in sorted({x.generation for x in tree}):
        mine = [(i, x) for i, x in enumerate(tree) if x.generation == g]
        draw, here = _draw(key, F.lit(f"generation {g}"), F.lit(float(sum(x.weight for _, x in mine)))), _descend(key, mine)
        place = here if place is None else F.when(draw < least, here).otherwise(place)
        least = draw if least is None else F.least(least, draw)
    return place


def assign(docs: DataFrame, tree: list[Leaf], larger: list[Leaf] | None = None, slot_buckets: int = 1024) -> DataFrame:
    """Place documents (doc_id, text) on shards and number them within each.

    Slots are gapless: rows are dealt to ``slot_buckets`` buckets of a shard,
    numbered inside each, and a table of bucket sizes (shards x ``slot_buckets``
    rows, broadcast if that is a million or less) shifts them; no task holds a whole shard.
    Buckets follow the row's place, not its key, so rows of one doc_id are
    dealt as well; the rows, without texts, are pinned by a written table. Null
    text has size 1 and the checksum of an empty text, very long texts are
    measured whole; null doc_ids share a shard; repeated rows go to the same
    shard under slots of their own. An empty table gives no rows and extra
    columns are ignored.
    """
    key = F.col("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    leaf = lambda at: F.element_at(F.array(*[F.struct(F.lit(x.region).alias("region"), F.lit(x.rack).alias("rack"), F.lit(x.shard).alias("shard")) for x in tree]), at + 1)
    later = F.element_at(F.array(*[F.lit(x.shard) for x in larger]), descend(key, larger) + 1) if larger else F.lit(None).cast("int")
    rows = docs.select(
        key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), leaf(descend(key, tree)).alias("at"), later.alias("grown_shard"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    rows = written(rows.select("doc_id", "size", "text_crc32", "at.*", "grown_shard", "bucket"), "shards")
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within))
    few = len(tree) * slot_buckets <= 1_000_000  # the rows of ``starts``; of very many shards they are joined by a shuffle
    placed = numbered.join(F.broadcast(starts) if few else starts, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard", "region", "rack")
