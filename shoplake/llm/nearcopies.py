"""Near copies: SimHash fingerprints in the trie join, checked by the Jaccard similarity of word shingles.

The trie join finds fingerprints within a few bits, and what it finds is checked
by whole shingle sets. Documents of similarity 0.8 differ in ten bits or so, where
a trie over 64 bits prunes next to nothing, so pairs beyond the budget come from
an exact join: sort each document's shingles in one common order; two sets of
similarity t share a shingle among the first n - ceil(t n) + 1 of each, so
documents meet in a join on these alone and no pair of similarity t or more is
missed. Shingles that are frequent in a sample come last in the order; any order
gives the same pairs, this one only keeps common passages out of the join. Pairs
that are in one group already are not made. Candidates are
compared by parity bits, which rule out most that differ, and the others by their
whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.components import components
from shoplake.llm.simhash import links, majority
from shoplake.llm.store import numbered, written


#: Least number of a document's parity bits. Bit b is set if an odd number of its shingles has the hash b modulo the
#: number of bits, so the bits in which two documents differ are no more than the shingles in which they do: a bound
#: that spares most comparisons of whole sets. A document has at least a bit for each shingle, so the bound is as sharp
#: for long ones; the halves of a document's bits, one over the other, are its bits at half the number.
BITS = 512
#: Columns of a document's bits folded to the least number of them.
FOLDED = [f"p{i}" for i in range(BITS // 64)]


def parity(found: np.ndarray) -> bytes:
    """Parity bits of distinct hashes, the least power of two of bits that are as many as they."""
    bits = max(BITS, 1 << (len(found) - 1).bit_length()) if len(found) else BITS
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int = BITS // 8) -> np.ndarray:
    """Bytes of parity bits at a lesser number of bits, ``size`` bytes of them."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two documents differ, at the lesser number of bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _near(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, u_n, u_bits, v_n, v_bits) to the pairs that the parity bits don't rule out."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            batch = whole.slice(lo, 2000)
            a, b = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            differ = np.zeros(len(a), dtype=np.int64)
            short = np.array([len(x) == len(y) == BITS // 8 for x, y in zip(a, b)], dtype=bool)
            if short.any():
                x, y = (np.frombuffer(b"".join(c[i] for i in np.flatnonzero(short).tolist()), np.uint64).reshape(-1, BITS // 64) for c in (a, b))
                differ[short] = np.bitwise_count(x ^ y).sum(axis=1)
            for i in np.flatnonzero(~short).tolist():
                differ[i] = differing(a[i], b[i])
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            kept = np.flatnonzero(differ * (1 + similarity) <= sizes * (1 - similarity) + 1e-6)
            if len(kept):
                yield batch.select(["u", "v"]).take(pa.array(kept))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; a text of fewer words is one shingle, a word-less one has none."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = ((ends - size)[: 1 - shingle or None], ends[shingle - 1 :]) if len(words) > shingle else ([0], [len(joined)])
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(list(starts), list(ends))], dtype=np.uint64)
    return np.unique(hashes.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            rows = batch.slice(lo, 500)
            found = [shingle_set(t, shingle) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])


def _prefixes(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            digests, sizes, heads, bits, prints, short = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(majority(found))
                sizes.append(len(found))
                last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(len(found), dtype=bool)
                bits.append(parity(found))
                short.append(folded(np.frombuffer(bits[-1], np.uint8)).view(np.int64))
                heads.append(np.r_[found[~last], found[last]][: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(prints, pa.int64()), *[pa.array(x) for x in np.array(short, dtype=np.int64).reshape(-1, len(FOLDED)).T]], names=["node", "digest", "n", "head", "bits", "fp", *FOLDED])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches, sorted by the first, cut between keys only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut or (held and held[-1][0][-1] != rows[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [x[:cut] for x in rows])]
            held = []
        held.append([x[cut:] for x in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, pos), sorted by key, that have their key in common with another."""
    for rows in _whole_keys(batches):
        same = rows[0][1:] == rows[0][:-1]
        kept = np.r_[same, False] | np.r_[False, same]
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in rows], names=["key", "node", "n", "pos"])


def _centres(key: np.ndarray, node: np.ndarray, n: np.ndarray, grp: np.ndarray, salt: int) -> np.ndarray:
    """For each row, sorted by key, the row that all rows of its key are compared with: one of the group that has most of them, or the one of middle size if none has two."""
    mixed = (node.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    order = np.lexsort((mixed, grp, key))
    runs = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (grp[order][1:] != grp[order][:-1])])
    sizes, keys = np.diff(np.r_[runs, len(key)]), key[order][runs]
    best = np.lexsort((-sizes, keys))
    best = best[np.r_[True, keys[best][1:] != keys[best][:-1]]]  # a key's largest group
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[starts, len(key)])
    middle = np.lexsort((node, n, key))[starts + many // 2]
    return np.repeat(np.where(sizes[best] > 1, order[runs[best]], middle), many)


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float, salt: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, pos, grp), sorted by key, to pairs (u, v) of different groups that may reach the similarity, with how many keys show it: all that folded parity bits, in more columns, don't rule out, or with the centre of each key only."""
    for key, node, n, pos, grp, *bits in _whole_keys(batches):
        if salt is None:
            order = np.lexsort((n, key))
            key, node, n, pos, grp, *bits = (x[order] for x in (key, node, n, pos, grp, *bits))

        def kept(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            overlap = np.minimum(n[i] - pos[i], n[j] - pos[j])  # at most, if this is the first shingle they share
            near = (grp[i] != grp[j]) & (overlap * (1 + similarity) + 1e-6 >= similarity * (n[i] + n[j]))
            i, j = i[near], j[near]
            if bits and len(i):
                differ = sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in bits)
                near = differ * (1 + similarity) <= (n[i].astype(np.int64) + n[j]) * (1 - similarity) + 1e-6
                i, j = i[near], j[near]
            if len(i):
                a, b = node[i], node[j]
                pairs, keys = np.unique(np.stack([a, b] if salt is not None else [np.maximum(a, b), np.minimum(a, b)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(keys)], names=["u", "v", "keys"])

        if salt is not None:
            yield from kept(np.arange(len(key)), _centres(key, node, n, grp, salt))
            continue
        i, step = np.arange(len(key)), 1
        while len(i):
            i = i[i + step < len(key)]
            i = i[(key[i] == key[i + step]) & (n[i] + 1e-6 >= similarity * n[i + step])]
            if len(i):
                yield from kept(i, i + step)
            step += 1


def _common(texts: DataFrame, shingle: int, sample: int = 5_000, share: float = 0.1, most: int = 500_000) -> np.ndarray:
    """Shingles that are frequent in a sample of rows: only where they stand in the order depends on it, no result.

    The sample grows with the table, so that a passage of fifty documents or so
    is in it five times at any size, and what stays in front is shared by few.
    """
    rows = max(1, texts.count())
    part = min(1.0, max(share, sample / rows))
    some = texts.filter(F.xxhash64("node").cast("double") < F.lit((part - 0.5) * 2.0**64))
    counted = some.mapInArrow(lambda it: _sets(it, shingle), "node long, shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").count()
    return np.sort(counted.filter("count >= 5").orderBy(F.desc("count"), "s").limit(most).select("s").toPandas()["s"].to_numpy(dtype=np.int64))


def copies(texts: DataFrame, similarity: float = 0.8, shingle: int = 5, budget: int = 3) -> DataFrame:
    """The nodes of ``texts`` (node, text) that aren't the least of their group; documents of the similarity or more are linked, groups are connected.

    ``texts`` is read several times and has to give the same nodes each time, so they come from a written table (``store.numbered``), not from a
    number made while reading; nodes are not null and distinct.
    Null and word-less texts are copies of each other. ``budget`` bits of a
    fingerprint may differ in the trie join; it shifts work between the two
    joins and changes no result.
    """
    common = _common(texts, shingle)
    prints = written(texts.mapInArrow(lambda it: _prefixes(it, shingle, similarity, common), "node long, digest binary, n long, head array<long>, bits binary, fp long, " + ", ".join(f"{c} long" for c in FOLDED)), "near-prefixes")
    least = written(prints.groupBy("digest").agg(F.min("node").alias("node")).select("node"), "near-distinct")

    def side(table: DataFrame, end: str) -> DataFrame:
        return table.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in table.columns if c != "node"])

    def verified(found: DataFrame) -> DataFrame:
        """The pairs (u, v) that reach the similarity."""
        sketch = prints.select("node", "n", "bits")
        met = found.join(side(sketch, "u"), "u").join(side(sketch, "v"), "v").select("u", "v", "u_n", "u_bits", "v_n", "v_bits")
        pairs = written(met.mapInArrow(lambda it: _near(it, similarity), "u long, v long"), "near-candidates")
        asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        sets = written(texts.join(asked, "node", "left_semi").mapInArrow(lambda it: _sets(it, shingle), "node long, shingles array<long>"), "near-sets")
        sizes, common = F.size("u_shingles") + F.size("v_shingles"), F.size(F.array_intersect("u_shingles", "v_shingles"))
        both = pairs.join(side(sets, "u"), "u").join(side(sets, "v"), "v").filter(common * (1 + similarity) + 1e-6 >= sizes * similarity)
        return written(both.select("u", "v"), "near-links")

    distinct = prints.join(least, "node", "left_semi")
    # Equal fingerprints are one leaf of the trie, and are compared with the least that has it.
    leaves = written(distinct.groupBy("fp").agg(F.min("node").alias("node")), "near-leaves")
    same = distinct.select("fp", F.col("node").alias("u")).join(leaves.withColumnRenamed("node", "v"), "fp").filter("u <> v").select("u", "v")
    found = verified(links(leaves.select("fp", "node"), budget).unionByName(same).distinct())
    rows = distinct.select("node", "n", F.posexplode("head").alias("pos", "key")).select("key", "node", F.col("n").cast("int").alias("n"), "pos")
    met = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key long, node long, n int, pos int"), "near-met")
    # The exact join. First each document with one other, three times: of the centres of its keys, members of the largest groups there,
    # the one it has most keys in common with. Large groups are one by then and nothing of them is joined any more; then all pairs of what are two groups still,
    # but for those that parity bits, sent with the keys in this round, rule out where keys meet.
    for salt in (0, 1, 2, None):
        groups = components(found).withColumnRenamed("u", "node")
        grouped = met.join(groups, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("grp"))
        if salt is None:
            grouped = grouped.join(prints.select("node", *FOLDED), "node").select("key", "node", "n", "pos", "grp", *FOLDED)
        dealt = grouped.repartition("key").sortWithinPartitions("key")
        seen = dealt.mapInArrow(lambda it, s=salt: _candidates(it, similarity, s), "u long, v long, keys long").groupBy("u", "v").agg(F.sum("keys").alias("keys"))
        if salt is not None:
            seen = seen.groupBy("u").agg(F.max(F.struct("keys", F.negative("v").alias("v"))).alias("most")).select("u", F.negative("most.v").alias("v"))
        found = found.unionByName(verified(seen.select("u", "v")))
    found = components(found)
    return prints.select("node").join(least, "node", "left_anti").unionByName(found.select(F.col("u").alias("node")))


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near copies of ``docs`` (text), with all its columns: the first in the order of the files read.

    Rows are told apart by numbers that are written with them once, not by doc_id,
    so null and repeated ids are no special case, and ``docs`` is read once and may be any table.
    Null and word-less texts are one group, very long texts are compared
    whole, an empty table gives no rows, columns of any name are kept.
    """
    held = numbered(docs, "near-rows")
    gone = written(copies(held.select("node", F.col("whole.text").cast("string").alias("text")), similarity, shingle), "near-copies")
    return held.join(gone, "node", "left_anti").select("whole.*")
