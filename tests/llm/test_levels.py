import random

import pytest

from shoplake.llm import chat


def brute(calls, needs):
    level = {}
    while True:
        more = {c: 1 + max((level[n] for d, n in needs if d == c and n in calls), default=-1) for c in calls if c not in level and all(n in level for d, n in needs if d == c and n in calls)}
        if not more:
            return {c: level.get(c) for c in calls}
        level |= more


def found(spark, calls, needs):
    """Levels of one conversation, beside another that uses the same identifiers without any needs."""
    both = spark.createDataFrame([(c, i) for c in (1, 2) for i in calls], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, *n) for n in needs], "conv_id long, call_id string, needed string")
    # In one task, and the conversation without needs in one task beside the other by rounds.
    ways = [chat.levels(both, edges, most).collect() for most in (500_000, len(calls))]
    for out in ways:
        assert {r.level for r in out if r.conv_id == 2} == {0} and len(out) == 2 * len(calls)
    first, *others = [{r.call_id: r.level for r in out if r.conv_id == 1} for out in ways]
    assert all(x == first for x in others)
    return first


def test_several_needs(spark):
    diamond = [("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "d"), ("f", "e"), ("f", "a"), ("f", "a"), ("f", "gone")]
    cycle = [("x", "y"), ("y", "x"), ("p", "a"), ("p", "x"), ("q", "p"), ("s", "t"), ("s", "a"), ("t", "s")]
    got = found(spark, "abcdefxypqst", diamond + cycle)
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5} | dict.fromkeys("xypqst")
    rng = random.Random(3)
    calls = [f"n{i}" for i in range(80)]
    needs = [(f"n{i}", f"n{rng.randrange(max(0, i - 6), i)}") for i in range(1, 80) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] + [("n40", "n44"), ("n41", "n41")]
    assert found(spark, calls, needs) == brute(calls, needs)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_by_brute_force(spark, seed):
    """Fans into and out of single calls, and sometimes edges that close cycles."""
    rng = random.Random(seed)
    calls = [f"n{i}" for i in range(40)]
    needs = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 40) for _ in range(rng.choice([0, 1, 2]))]
    needs += [(f"n{i}", "n3") for i in range(10, 30)] + [("n39", f"n{i}") for i in range(20)]
    needs += [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(seed)]
    assert found(spark, calls, needs) == brute(calls, needs)


def test_repeated_call_with_different_references(spark):
    rows = [(1, "a", 1, "search", "{}"), (1, "b", 2, "search", '{"after":"a"}'), (1, "c", 3, "search", '{"after":"a"}'), (1, "c", 3, "search", '{"after":"b"}')]
    out = chat.link(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string"), spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), [chat.Field("search", "after", "string", False)])
    assert sorted((r.call_id, r.level) for r in out.collect()) == [("a", 0), ("b", 1), ("c", 2), ("c", 2)]
