"""Benchmark decontamination by spaced seeds.

A mask selects some word positions of a window and ignores the others, so its
hash survives substitutions at ignored positions. Hashes of all test windows are
joined with those of training windows, each once for a text; for a document and an
item that meet, places with equal hashes name diagonals, along which the words are
compared and the best stretch, mismatches counted against it, is kept if it is long enough.

Most training windows share their hash with no test window. A bitmap of fixed size
over the test hashes, which goes to every task, drops nearly all of these before
the join and none that would meet. So memory doesn't grow with the benchmark: a
larger one fills the bitmap and lets more windows through to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.store import numbered, written

#: Fixed masks: 1 compares a word, 0 ignores it.
MASKS = ("11101011", "1101100111", "110010110101")
SHORTEST = min(map(len, MASKS))
#: Items shorter than every mask are looked for as a whole.
ALL_MASKS = (*MASKS, *("1" * n for n in range(1, SHORTEST)))
HITS = "doc_id long, item_id long, doc_start long, item_start long, length long, matched long, item_words long, seed_hits long"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPREAD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) % 2**64 | 1 for i in range(64)], dtype=np.uint64)
#: Bits of the bitmap, as a power of two: 8 MB.
BITS = 26


def hashed(text: str | None) -> np.ndarray:
    """Hashes of a text's lower-cased words without ASCII marks."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in (text or "").lower().encode("utf-8").translate(None, _MARKS).split()], dtype=np.uint64)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of ``words`` under ``mask``; the mask's own number keeps masks apart."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, len(mask) * 1_000_003, dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += (words[i : i + n] ^ (words[i : i + n] >> np.uint64(29))) * _SPREAD[i]
    return out ^ (out >> np.uint64(32))


def _test_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) to rows (item, item_id, words, seed, at): every window of every mask that suits the item."""
    for batch in batches:
        for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = hashed(text)
            short = len(words) < SHORTEST
            found = [seeds(words, m) for m in (["1" * len(words)] if short else MASKS)] if len(words) else []
            keys = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
            at = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item], pa.int64()), pa.array([item_id], pa.int64()), pa.array([words.tobytes()], pa.binary()), pa.array([keys.view(np.int64)], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64()))],
                names=["item", "item_id", "words", "seeds", "ats"],
            )


def _places(seeds_: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each seed."""
    return seeds_ >> np.uint64(64 - bits), (seeds_ * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - bits)


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).flatten().to_numpy().view(np.uint64)
        if not len(found):
            continue
        places = np.unique(np.concatenate(_places(found, bits)))
        word, one = np.unique(places >> np.uint64(6), return_index=True)
        held = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), one)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], names=["word", "bits"])


def _hits(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, masks: tuple[str, ...], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) to documents with windows that may be in the benchmark."""
    for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
        rows = []
        for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            words, keys, at = hashed(text), [], []
            for mask in masks:
                mine = seeds(words, mask)
                a, b = _places(mine, bits)
                bit = lambda x: bitmap[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)
                maybe = np.flatnonzero(bit(a) & bit(b))
                keys.append(mine[maybe])
                at.append(maybe)
            if any(map(len, keys)):
                rows.append((rid, doc_id, words.tobytes(), np.concatenate(keys).view(np.int64), np.concatenate(at)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rid", "doc_id", "words", "seeds", "ats"])


def seed_hits(mine: np.ndarray, mine_at: np.ndarray, test: np.ndarray, test_at: np.ndarray, before: int, size: int, most: int = 2_000_000) -> np.ndarray:
    """Equal seeds of each diagonal, of ``size`` that begin ``before`` places left of the document.

    Places of one seed that follow each other in the test are one run, and a run
    adds to neighbouring diagonals, so that a repeated word costs a step for each place in
    the document and not for each pair; at most ``most`` steps are held at a time.
    """
    order = np.lexsort((test_at, test))
    seed, at = test[order], test_at[order]
    first = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[first[1:], len(seed)] - 1
    lo, hi = np.searchsorted(seed[first], mine, side="left"), np.searchsorted(seed[first], mine, side="right")
    met = np.flatnonzero(hi > lo)
    mine_at, lo, many = mine_at[met], lo[met], (hi - lo)[met]
    edges = np.zeros(size + 1, dtype=np.int64)
    ends, begin = np.cumsum(many), 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        part = np.repeat(np.arange(begin, end), many[begin:end])
        run = lo[part] + np.arange(len(part)) - np.repeat(ends[begin:end] - many[begin:end] - (ends[begin - 1] if begin else 0), many[begin:end])
        edges += np.bincount(mine_at[part] - at[last[run]] + before, minlength=size + 1)
        edges -= np.bincount(mine_at[part] - at[first[run]] + before + 1, minlength=size + 1)
        begin = end
    return np.cumsum(edges)[:size]


def best_stretch(words: np.ndarray, test: np.ndarray, hits: np.ndarray, least: int, penalty: int, cells: int = 2_000_000) -> tuple[int, ...] | None:
    """(gain, doc_start, item_start, length, matched, item_words, seed_hits) of the greatest of the best stretches along diagonals with hits, if it reaches ``least``.

    Diagonals are compared some at a time, ``cells`` words at most, those with most hits as well as those with one.
    """
    m, best = len(test), None
    limit = min(least, max(1, int(0.8 * m)))
    diagonals = np.flatnonzero(hits)
    for lo in range(0, len(diagonals), max(1, cells // m)):
        shift = diagonals[lo : lo + max(1, cells // m)] - m
        at = shift[:, None] + np.arange(m)
        inside = (at >= 0) & (at < len(words))
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == test)
        # Places outside the document are like other words: a stretch neither begins nor ends there.
        run = np.zeros((len(shift), m + 1), dtype=np.int64)
        np.cumsum(np.where(same, 1, -penalty), axis=1, out=run[:, 1:])
        gain = run - np.minimum.accumulate(run, axis=1)
        end = gain.argmax(axis=1)
        top = gain[np.arange(len(shift)), end]
        high = int(top.max())
        if high < limit or (best and high < best[0]):
            continue
        for k in np.flatnonzero(top == high).tolist():
            start = int(run[k, : end[k] + 1].argmin()) if end[k] else 0
            got = (high, int(shift[k]) + start, start, int(end[k]) - start, int(same[k, start : end[k]].sum()), m, int(hits[diagonals[lo + k]]))
            best = max(best, got) if best else got
    return best


def _verified(mine: pa.Table, tests: pa.Table, least: int, penalty: int) -> pa.Table:
    """A document and the items that have a seed in common with it, to FOUND."""
    rows = []
    numbers = lambda column, kind: np.asarray(column.as_py() if not isinstance(column, pa.ListScalar) else column.values, dtype=kind)
    for i in range(mine.num_rows):
        words = np.frombuffer(mine["words"][i].as_py(), np.uint64)
        seeds_, ats = numbers(mine["seeds"][i], np.int64), numbers(mine["ats"][i], np.int64)
        for k in range(tests.num_rows):
            test = np.frombuffer(tests["words"][k].as_py(), np.uint64)
            hits = seed_hits(seeds_, ats, numbers(tests["seeds"][k], np.int64), numbers(tests["ats"][k], np.int64), len(test), len(words) + len(test))
            if best := best_stretch(words, test, hits, least, penalty):
                rows.append((mine["rid"][i].as_py(), mine["doc_id"][i].as_py(), tests["item"][k].as_py(), tests["item_id"][k].as_py(), *best))
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(FOUND))], names=FOUND)


FOUND = ["rid", "doc_id", "item", "item_id", "gain", "doc_start", "item_start", "length", "matched", "item_words", "seed_hits"]


def _found(rows: DataFrame, benchmark: DataFrame, least: int, penalty: int, bits: int) -> DataFrame:
    """``rows`` (rid, doc_id, text) to FOUND, the best stretch of each row and item."""
    spark = rows.sparkSession
    long = lambda c: F.col(c).cast("long").alias(c)
    tests = benchmark.select(long("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    tests = written(tests.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(_test_seeds, "item long, item_id long, words binary, seeds array<long>, ats array<long>"), "leaks-tests")
    # At most 2^20 rows, whatever the benchmark.
    held = tests.select("seeds").mapInArrow(lambda it: _bits(it, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[np.array([r.word for r in held], dtype=np.int64)] = np.array([r.bits for r in held], dtype=np.int64).view(np.uint64)
    sizes = tests.select((F.octet_length("words") / 8).cast("int").alias("n")).filter(F.col("n") < SHORTEST).distinct().collect()
    masks = (*MASKS, *("1" * r.n for r in sizes if r.n))
    handle = spark.sparkContext.broadcast(bitmap)
    hits = written(rows.mapInArrow(lambda it: _hits(it, handle.value, masks, bits), "rid long, doc_id long, words binary, seeds array<long>, ats array<long>"), "leaks-hits")
    # Each seed once on either side: what repeats within a text is no pair. Which places meet is found below, for a document and an item at a time.
    once = lambda df, key: df.select(key, F.explode(F.array_distinct("seeds")).alias("seed"))
    pairs = once(hits, "rid").join(once(tests, "item"), "seed").select("rid", "item").distinct()
    asked = pairs.join(tests, "item").withColumnRenamed("rid", "row")
    return hits.groupBy("rid").cogroup(asked.groupBy("row")).applyInArrow(lambda a, b: _verified(a, b, least, penalty), ", ".join(f"{c} long" for c in FOUND))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 10, penalty: int = 2, bits: int = BITS) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text): one row per document and item found in it.

    A stretch scores 1 for each equal word and -``penalty`` for each other one
    and counts from ``least`` on (items of few words: from four fifths of them).
    Of a document's stretches of one item the best is given, of equals the last.
    Only found documents have rows. The bitmap has 2 to the power of ``bits``
    bits; fewer let more windows through and change no result. Null and empty texts on either side match
    nothing, very long ones are searched whole, repeated rows of ``docs`` are
    reported one by one and those of ``benchmark`` once, a null doc_id is
    reported as null, other columns of either table are ignored, empty tables
    give no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(rows, benchmark, least, penalty, bits).select(*[c.split()[0] for c in HITS.split(", ")])


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 10, penalty: int = 2, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` (text) that overlap with no benchmark item, with all their columns.

    Rows are told apart by numbers that are written with them once, so ``docs``
    is read once and may be any table. Null and empty texts stay, and so does every row
    if the benchmark is empty; repeated rows go or stay together.
    """
    held = numbered(docs, "leaks-rows")
    rows = held.select(F.col("node").alias("rid"), F.lit(None).cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"))
    gone = written(_found(rows, benchmark, least, penalty, bits).select(F.col("rid").alias("node")).distinct(), "leaks")
    return held.join(gone, "node", "left_anti").select("whole.*")
