"""Linking tool calls with their results.

Calls and results meet in a hash join on conversation and identifier. A call that
names others in its arguments is ordered after all of them, topologically;
arguments are checked against the tool's schema and written as canonical JSON:
sorted keys, no white space, one form for equal numbers.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from decimal import Context, Decimal
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shoplake.llm.store import written


#: Digits of a number that count, and its greatest exponent.
CONTEXT = Context(prec=10_000, Emax=999_999, Emin=-999_999)
KEYS = ["conv_id", "call_id"]


class Field(NamedTuple):
    tool: str
    name: str
    kind: str  # a type of Spark: "string", "long", "double", "boolean", "array<string>"
    required: bool = True
    low: float | None = None
    high: float | None = None


def schema_errors(name: Column, arguments: Column, fields: list[Field]) -> Column:
    """Array of error names for variant ``arguments`` of tool ``name``; fields the schema doesn't know are errors too."""
    out = F.when(~name.isin(sorted({f.tool for f in fields})) | name.isNull(), F.array(F.lit("unknown_tool")))
    for tool in sorted({f.tool for f in fields}):
        mine = [f for f in fields if f.tool == tool]
        tests = [F.when(arguments.isNull(), F.lit("not_json"))]
        for f in mine:
            raw, typed = F.try_variant_get(arguments, f"$.{f.name}", "string"), F.try_variant_get(arguments, f"$.{f.name}", f.kind)
            if f.required:
                tests.append(F.when(arguments.isNotNull() & raw.isNull(), F.lit(f"missing:{f.name}")))
            tests.append(F.when(raw.isNotNull() & typed.isNull(), F.lit(f"type:{f.name}")))
            if f.low is not None:
                tests.append(F.when(typed < F.lit(f.low), F.lit(f"low:{f.name}")))
            if f.high is not None:
                tests.append(F.when(typed > F.lit(f.high), F.lit(f"high:{f.name}")))
        extra = F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*[F.lit(f.name) for f in mine]))
        tests.append(F.when(F.size(extra) > 0, F.lit("unknown_field")))
        out = out.when(name == tool, F.array_compact(F.array(*tests)))
    return out


def number(x: Decimal) -> str:
    """Equal numbers alike: plain digits from 1e-6 up to 1e21, else one digit, the others and an exponent."""
    sign, digits, power = x.normalize(CONTEXT).as_tuple()
    if not any(digits):
        return "0"
    text, point = "".join(map(str, digits)), len(digits) + power  # 0.text * 10^point
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else text[:point] + "." + text[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if text[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def canonical_json(text: str | None) -> str | None:
    """JSON with keys sorted by UTF-16 code units, no white space and numbers in one form; null for what isn't JSON."""

    def write(x) -> str:
        if isinstance(x, Decimal):
            return number(x)
        if isinstance(x, dict):
            return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + write(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
        return "[" + ",".join(map(write, x)) + "]" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)

    try:
        return write(json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=float)) if text is not None else None
    except (ValueError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


def _quoted(c: Column) -> Column:
    """A string as JSON, null as null."""
    inside = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _ordered(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (conversation, call, needed or null) of whole conversations to (conversation, call, level), each call once."""
    found: dict[tuple, int | None] = {}
    edges = set()
    for conv, call, needed in rows:
        if needed is None:
            found[conv, call] = None
        else:
            edges.add((conv, needed, call))
    left, above = Counter(), defaultdict(list)
    for conv, needed, call in edges:
        if (conv, needed) in found and (conv, call) in found:
            left[conv, call] += 1
            above[conv, needed].append((conv, call))
    ready = [k for k in found if not left[k]]
    for k in ready:
        found[k] = 0
    deepest = Counter()
    while ready:
        for k in above.pop(key := ready.pop(), ()):
            deepest[k] = max(deepest[k], found[key] + 1)
            left[k] -= 1
            if not left[k]:
                found[k] = deepest[k]
                ready.append(k)
    yield from ((*k, n) for k, n in found.items())


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, call_id, needed), sorted by conversation, to levels; waits for whole conversations only."""
    names, held = [*KEYS, "level"], []

    def levels_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*_ordered(rows))) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.string(), pa.int64()])], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        cut = len(rows)
        while cut and rows[cut - 1][0] == rows[-1][0]:
            cut -= 1
        if cut:
            yield levels_of(held + rows[:cut])
            held = []
        held += rows[cut:]
    if held:
        yield levels_of(held)


def levels(calls: DataFrame, needs: DataFrame, most: int = 500_000) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the deepest call waited for; null on and behind cycles.

    ``calls`` (conv_id, call_id), ``needs`` (conv_id, call_id, needed): a call
    waits for calls of its own conversation, and identifiers that aren't calls
    there don't bind. A conversation is ordered in one task, in time linear in
    its calls and needs; one with more than ``most`` of these goes by rounds of
    joins instead, with the same levels.
    """
    nodes = calls.select(*KEYS).dropna()
    rows = nodes.withColumn("needed", F.lit(None).cast("string")).unionByName(needs.select(*KEYS, "needed").dropna())
    huge = rows.groupBy("conv_id").count().filter(F.col("count") > most).select("conv_id")
    kind = calls.schema["conv_id"].dataType.simpleString()
    if huge.isEmpty():
        return rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_in_groups, f"conv_id {kind}, call_id string, level long")
    huge = F.broadcast(written(huge, "chat-huge"))  # one row for each ``most`` rows at most
    small = rows.join(huge, "conv_id", "left_anti").repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_in_groups, f"conv_id {kind}, call_id string, level long")
    return small.unionByName(_by_rounds(nodes.join(huge, "conv_id", "left_semi").distinct(), needs.join(huge, "conv_id", "left_semi")))


def _by_rounds(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """Levels by joins on written tables.

    Calls with one need form chains, which end at a call with none or with
    several; every round doubles how far a call has looked up its chain, so a
    chain of n calls takes log2(n) joins, and a round that settles none leaves
    only cycles. Then a round of joins for each depth settles the calls with
    several needs, once all of theirs are known; needs that are settled leave
    the table.
    """
    bound = needs.join(nodes.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_semi").select(*KEYS, "needed")
    ups = bound.groupBy(*KEYS).agg(F.min("needed").alias("up"), F.max("needed").alias("last"))
    several = F.col("up") < F.col("last")
    state = nodes.join(ups, KEYS, "left").select(*KEYS, F.when(several, None).otherwise(F.col("up")).alias("up"), F.when(F.col("up").isNull() | several, 0).otherwise(1).cast("long").alias("level"), F.when(several, F.col("call_id")).alias("anchor"))
    state = written(state, "chat-levels")
    left, branching = state.agg(F.count("up"), F.count("anchor")).first()
    while left:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"), F.col("anchor").alias("end"))
        state = written(state.join(above, ["conv_id", "up"], "left").select(*KEYS, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("anchor", "end").alias("anchor")), "chat-levels")
        now = state.filter("up is not null").count()
        if now == left:
            break
        left = now
    if not branching:
        return state.select(*KEYS, F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    # What each need of a call with several comes to: a number, a number above another such call, or a cycle.
    waits = bound.distinct().join(state.filter("anchor = call_id").select(*KEYS), KEYS, "left_semi")
    below = state.select("conv_id", F.col("call_id").alias("needed"), (F.col("level") + 1).alias("value"), "anchor", F.col("up").isNotNull().alias("stuck"))
    waits = written(waits.join(below, ["conv_id", "needed"]).select(*KEYS, F.when(~F.col("stuck"), F.col("value")).alias("value"), "anchor", (F.col("anchor").isNull() & ~F.col("stuck")).alias("known")), "chat-waits")
    bases = []
    while True:
        settled = waits.groupBy(*KEYS).agg(F.max("value").alias("base"), F.min(F.col("known").cast("int")).alias("all")).filter("all = 1").select("conv_id", F.col("call_id").alias("anchor"), "base")
        settled = written(settled, "chat-bases")
        if settled.isEmpty():
            break
        bases.append(settled)
        open_ = waits.join(settled.select("conv_id", F.col("anchor").alias("call_id")), KEYS, "left_anti")
        value = F.when(F.col("known"), F.col("value")).otherwise(F.col("value") + F.coalesce("base", F.lit(0)))
        waits = written(open_.join(settled, ["conv_id", "anchor"], "left").select(*KEYS, value.alias("value"), "anchor", (F.col("known") | F.col("base").isNotNull()).alias("known")), "chat-waits")
    spark = nodes.sparkSession
    base = spark.read.schema(bases[0].schema).parquet(*[f for b in bases for f in b.inputFiles()]) if bases else waits.limit(0).select("conv_id", "anchor", F.col("value").alias("base"))
    level = F.when(F.col("up").isNull(), F.when(F.col("anchor").isNull(), F.col("level")).otherwise(F.col("level") + F.col("base")))
    return state.join(base, ["conv_id", "anchor"], "left").select(*KEYS, level.alias("level"))


def link(calls: DataFrame, results: DataFrame, fields: list[Field], reference: str = "after") -> DataFrame:
    """One row per call of ``calls`` (conv_id, call_id, turn, name, arguments) and per result without a call.

    ``results``: (conv_id, call_id, turn, content); an identifier names a call
    of its own conversation only. Of several results the first by turn is linked
    and all are counted; results without a turn come last, of one turn those with a
    content first, and a result whose content is null is linked as such. ``reference`` is the argument that names a call to wait
    for, or an array of several. A call's place in its conversation is (level,
    turn, call_id). Malformed arguments have null canonical JSON and the error
    not_json, null conversations and identifiers link to nothing and have level
    0, calls on a cycle have a null level, repeated rows are linked one by one,
    arguments and contents of any length are read whole, other columns of either
    table are ignored, empty tables give no rows.
    """
    parsed = calls.select(*KEYS, "turn", "name", F.try_parse_json(F.col("arguments")).alias("args"), "arguments")
    named = F.coalesce(F.try_variant_get("args", f"$.{reference}", "array<string>"), F.array(F.try_variant_get("args", f"$.{reference}", "string")))
    needs = parsed.select(*KEYS, F.explode(named).alias("needed")).dropna()
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = results.filter(known).groupBy(*KEYS).agg(F.min(F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.col("content").isNull().alias("none"), F.col("content").alias("content"))).alias("first"), F.count("*").alias("n_results")).select(*KEYS, F.col("first.content").alias("content"), "n_results")
    joined = parsed.filter(known).join(first.hint("shuffle_hash"), KEYS, "left").join(levels(calls, needs).hint("shuffle_hash"), KEYS, "left")
    # Calls without an identifier would meet in one task.
    loose = parsed.filter(~known).withColumns({"content": F.lit(None).cast("string"), "n_results": F.lit(None).cast("long"), "level": F.lit(0).cast("long")})
    joined = joined.unionByName(loose)
    canonical = F.concat(F.lit('{"arguments":'), _canonical(F.when(F.col("args").isNotNull(), F.col("arguments"))), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}"))
    linked = joined.select(
        *KEYS, "turn", "name", F.col("level").cast("long").alias("level"), F.col("n_results").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.array_join(schema_errors(F.col("name"), F.col("args"), fields), ",").alias("errors"), canonical.alias("canonical"), F.col("content").alias("result"),
    )
    have = calls.select(*KEYS).dropna().distinct()
    lost = results.filter(known).join(have, KEYS, "left_anti").unionByName(results.filter(~known))
    orphans = lost.select(F.col("conv_id").cast(calls.schema["conv_id"].dataType).alias("conv_id"), "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("n_results"), F.lit("orphan_result").alias("errors"), F.lit(None).cast("string").alias("canonical"), F.col("content").alias("result"))
    return linked.unionByName(orphans)
