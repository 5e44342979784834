"""Global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.store import written

#: Bits that hold a row's place within its partition in ``monotonically_increasing_id``.
_PLACE_BITS = 33


def _ranged(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """``df`` in ranges of ``order`` with _range and _place (from 1), pinned by a written table: bounds are sampled, so a lost executor would deal rows anew."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = written(ranged.sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")), "ranges")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return placed.withColumns({"_range": F.shiftright("_at", _PLACE_BITS), "_place": place}).drop("_at")


def _starts(placed: DataFrame, total: Column) -> DataFrame:
    """_start of each range: ``total`` over all ranges before it; a row for each range."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(total.alias("_n"))
    return F.broadcast(sizes.select("_range", F.sum("_n").over(before).alias("_start")))


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number", parts: int | None = None) -> DataFrame:
    """Number rows 1..n by ``order``, which has to be total.

    One shuffle: rows are dealt by ranges of ``order`` and sorted within each, so
    a row's place in its range is its place in the partition; a table with one
    count per range shifts it.
    """
    placed = _ranged(df, order, parts)
    joined = placed.join(_starts(placed, F.count("*")), "_range")
    return joined.withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_place")).select(*df.columns, name)


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows up to each by ``order``, which has to be total; no task holds more than a range."""
    placed = _ranged(df, order, parts)
    within = F.sum(value).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("_within", within).join(_starts(placed, F.sum(value)), "_range")
    return joined.withColumn(name, F.col("_within") + F.coalesce("_start", F.lit(0))).select(*df.columns, name)


def tile_ends(n: int, k: int) -> list[int]:
    """Places after which tiles 1 to k - 1 of NTILE(k) over ``n`` rows end."""
    return [n // k * j + min(j, n % k) for j in range(1, k)]


def keys_at(df: DataFrame, asked: dict[str, tuple[Column, list[int]]], tie: str, cells: int = 4096, few: int = 20_000) -> dict[str, list[tuple[int, int] | None]]:
    """For each measure (a whole-number expression, places from 1) the key (value, ``tie``) of the row at each place, by value and then ``tie``, both ascending; None at place 0.

    Nothing is sorted or dealt by range. Each pass counts rows in ``cells`` equal
    stretches between the bounds of every place, for all measures at once, and
    keeps the stretch that holds the place, until it has at most ``few`` rows, which are
    numbered; a single value that more rows share is searched on by ``tie``.
    """
    measures = {m: c.cast("long") for m, (c, _) in asked.items()}
    rows = df.select(F.col(tie).cast("long").alias("_t"), *[c.alias(f"_{m}") for m, c in measures.items()])
    ends = rows.agg(F.count("*").alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi"), *[f(f"_{m}").alias(f"{m}_{name}") for m in measures for f, name in ((F.min, "lo"), (F.max, "hi"))]).first()
    # What is looked for: [measure, place within the stretch, the value if it is settled, bounds, rows in the stretch].
    open_ = {(m, p): [m, p, None, ends[f"{m}_lo"], ends[f"{m}_hi"], ends["n"]] for m, (_, places) in asked.items() for p in places if p > 0}

    def inside(w: list) -> Column:
        at = F.col(f"_{w[0]}") if w[2] is None else F.col("_t")
        return at.between(w[3], w[4]) & (F.lit(True) if w[2] is None else F.col(f"_{w[0]}") == w[2])

    while wide := {k: w for k, w in open_.items() if w[5] > few}:
        steps = []
        for i, w in enumerate(wide.values()):
            if w[2] is None and w[3] == w[4]:  # one value: on by the tie
                w[2:5] = [w[3], ends["lo"], ends["hi"]]
            size = -(-(w[4] - w[3] + 1) // cells)
            cell = F.floor(((F.col(f"_{w[0]}") if w[2] is None else F.col("_t")) - w[3]) / size).cast("long")
            steps.append(F.when(inside(w), F.struct(F.lit(i).alias("i"), cell.alias("cell"))))
        counts = rows.select(F.explode(F.array_compact(F.array(*steps))).alias("s")).groupBy("s.i", "s.cell").count().collect()
        for i, w in enumerate(wide.values()):
            size = -(-(w[4] - w[3] + 1) // cells)
            for cell, count in sorted((r.cell, r["count"]) for r in counts if r.i == i):
                if w[1] <= count:
                    w[3:6] = [w[3] + cell * size, min(w[4], w[3] + (cell + 1) * size - 1), count]
                    break
                w[1] -= count
    found = {}
    if open_:
        near = rows.select(F.explode(F.array_compact(F.array(*[F.when(inside(w), F.struct(F.lit(i).alias("i"), F.col(f"_{w[0]}").alias("v"), F.col("_t").alias("t"))) for i, w in enumerate(open_.values())]))).alias("s")).select("s.*")
        place = F.row_number().over(Window.partitionBy("i").orderBy("v", "t"))
        wanted = F.element_at(F.array(*[F.lit(w[1]) for w in open_.values()]), F.col("i") + 1)
        found = {r.i: (r.v, r.t) for r in near.withColumn("p", place).filter(F.col("p") == wanted).collect()}
    at = {k: found[i] for i, k in enumerate(open_)}
    return {m: [at.get((m, p)) for p in places] for m, (_, places) in asked.items()}


def ntile_of(position: Column, n: Column, k: int) -> Column:
    """NTILE(k) of 1-based ``position`` among ``n`` rows, by arithmetic: the first n mod k tiles have one row more."""
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    return F.when(position <= big, F.floor((position - 1) / (q + 1)) + 1).otherwise(r + F.floor((position - 1 - big) / F.greatest(q, F.lit(1))) + 1).cast("int")


def ntile_scaled(df: DataFrame, k: int, order: list[Column], name: str) -> DataFrame:
    n = df.count()
    return global_row_number(df, order, "_pos").withColumn(name, ntile_of(F.col("_pos"), F.lit(n), k)).drop("_pos")
