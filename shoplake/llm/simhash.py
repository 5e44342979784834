"""SimHash fingerprints linked by a binary trie self-join.

Two fingerprints within k bits agree wholly on one of k + 1 blocks of bits. Each
distinct fingerprint is therefore dealt k + 1 times, rotated so that one block
leads: the leading bits are a subtree of the trie over that rotation, and a task
walks its subtrees. The walk takes pairs of trie nodes together, adds the bits
by which their paths differ, and drops a pair once the budget is exceeded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.components import components
from shoplake.llm.store import written


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that more than half of ``hashes`` have; 0 for none."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of word shingles; 0 for texts without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(size + 1) - 1
        hashes = [digest(joined[a:b], 42) for a, b in zip((ends - size)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def trie_pairs(values: np.ndarray, budget: int, skip: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``values`` (uint64) that share the first ``skip`` bits and differ in at most ``budget`` others.

    A node is a range of the sorted values. Frontiers longer than ``most`` node
    pairs are halved, so memory is bounded whatever the values are.
    """
    if len(values) < 2:
        return
    runs = np.flatnonzero(np.r_[True, np.diff(values >> np.uint64(64 - skip)) != 0]) if skip else np.array([0])
    lo, hi = runs, np.r_[runs[1:], len(values)]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    stack = [(skip, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, off = stack.pop()
        if not len(a0):
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            yield i[near], j[near]
            a0, a1, b0, b1, off = (x[~single] for x in (a0, a1, b0, b1, off))
        if not len(a0) or depth == 64:
            continue
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(depth, a0[:half], a1[:half], b0[:half], b1[:half], off[:half]), (depth, a0[half:], a1[half:], b0[half:], b1[half:], off[half:])]
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        cross, back = off < budget, (off < budget) & ~same
        n0 = np.concatenate([a0, am, a0[cross], am[back]])
        n1 = np.concatenate([am, a1, am[cross], a1[back]])
        m0 = np.concatenate([b0, bm, bm[cross], b0[back]])
        m1 = np.concatenate([bm, b1, b1[cross], bm[back]])
        e = np.concatenate([off, off, off[cross] + 1, off[back] + 1])
        live = (n1 > n0) & (m1 > m0) & ~((n0 == m0) & (n1 == m1) & (n1 - n0 == 1))
        stack.append((depth + 1, n0[live], n1[live], m0[live], m1[live], e[live]))


def _stars(values: np.ndarray, nodes: np.ndarray, budget: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found under one block as stars (node, least node linked to it here): a forest, never all pairs."""
    label = np.arange(len(values))
    for i, j in trie_pairs(values, budget, skip):
        while (differ := label[i] != label[j]).any():
            a, b = label[i[differ]], label[j[differ]]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, above := label[label]):
                label = above
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    found = np.flatnonzero(nodes != least[label])
    return nodes[found], least[label[found]]


def _walk(batches: Iterator[pa.RecordBatch], budget: int, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (block, rotated, node), sorted by block and rotated, to links. Waits for whole subtrees only."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block in np.unique(rows["b"]):
            part = rows[rows["b"] == block]
            part = part[np.argsort(part["v"], kind="stable")]
            u, v = _stars(part["v"], part["n"], budget, widths[int(block)])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        rows = np.empty(batch.num_rows, dtype=[("b", np.int64), ("v", np.uint64), ("n", np.int64)])
        rows["b"], rows["n"] = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        rows["v"] = batch.column(1).to_numpy().view(np.uint64)
        if not len(rows):
            continue
        lead = rows["v"] >> (64 - np.array(widths, dtype=np.uint64)[rows["b"]])
        cut = len(rows)
        while cut and rows["b"][cut - 1] == rows["b"][-1] and lead[cut - 1] == lead[-1]:
            cut -= 1
        if cut:
            yield from links(np.concatenate([*held, rows[:cut]]))
            held = []
        held.append(rows[cut:])
    if held:
        yield from links(np.concatenate(held))


def links(reps: DataFrame, budget: int = 2) -> DataFrame:
    """``reps`` (fp, node), one row per distinct fingerprint, to link stars (u, v)."""
    widths = [64 // (budget + 1) + (1 if i < 64 % (budget + 1) else 0) for i in range(budget + 1)]
    starts = [sum(widths[:i]) for i in range(budget + 1)]
    dealt = [F.struct(F.lit(i).cast("long").alias("block"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("rotated")) for i, s in enumerate(starts)]
    lead = F.lit(None)
    for i, w in enumerate(widths):
        lead = F.when(F.col("block") == i, F.shiftrightunsigned("rotated", 64 - w)).otherwise(lead)
    rows = reps.select(F.explode(F.array(*dealt)).alias("d"), "node").select("d.block", "d.rotated", "node").withColumn("lead", lead)
    near = rows.repartition("block", "lead").sortWithinPartitions("block", "lead").select("block", "rotated", "node")
    return near.mapInArrow(lambda it: _walk(it, budget, widths), "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null and word-less texts have fingerprint zero and link like any other.
    Repeated rows share a fingerprint, hence a component. A null doc_id is given
    its fingerprint's component, if a non-null one has that fingerprint, but is
    no node itself. An empty table gives no rows; extra columns are ignored.
    """
    prints = written(fingerprints(docs, shingle), "simhash")
    reps = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"))
    found = components(links(reps.select("fp", "node"), budget))
    named = written(reps.join(found.withColumnRenamed("u", "node"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "rows"), "simhash-names")
    # Fingerprints of many copies would meet in one task each. Those of a 500th of the rows are 500 at most, so they are broadcast.
    many = F.col("rows") * 500 >= prints.count()
    hot, rest = F.broadcast(named.filter(many).drop("rows")), named.filter(~many).drop("rows")
    joined = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(rest, "fp", "left"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
