"""Ranked lexical search by three uniform-threshold rounds over lists of postings.

One pass over the documents writes the lists: for each batch of documents and each
term that a query has, a block of (document, occurrences, length). Then, for all
queries at once:

1. the heads of a query's lists, ``k`` postings of each, give sums that no
   document's score is below, and the k-th best of those sums is a bound;
2. of every list come the postings that score a query's bound shared out evenly
   over its lists, or more; a document that has none can't reach the bound. What
   has come gives a better bound, and each document an upper one;
3. documents whose upper bound reaches it are looked up in all lists.

Blocks split a long list over tasks; a task holds some blocks and the best k of
each list or query it has seen, never a list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.cluster import broadcast_if_small
from shoplake.llm.store import written

#: Letters and digits of ASCII and all bytes of other characters are parts of terms; A-Z count as a-z.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bits of the bitmap of query terms, as a power of two: 1 MB.
BITS = 23
#: Documents of a batch.
BATCH = 2_000
LISTS = "term string, batch long, docs binary, tfs binary, ns binary, ids array<long>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERM).split()


def _places(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in words), dtype=np.int64, count=len(words))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, text) to rows (query, term, place), each term once."""
    for batch in batches:
        for query, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = sorted(set(terms(text)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(found), pa.int64()), pa.array([t.decode("utf-8") for t in found]), pa.array(_places(found))], names=["query", "term", "place"])


def _lists(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) to LISTS: a block per term, and a row without term that tells all documents' lengths and ids."""
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    import xxhash

    digest, shift = xxhash.xxh3_64_intdigest, 64 - BITS
    for whole in batches:
        for lo in range(0, whole.num_rows, BATCH):
            batch = whole.slice(lo, BATCH)
            ids = batch.column(1).to_pylist()
            blocks: dict[bytes, list[tuple[int, int, int]]] = {}
            sizes = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = terms(text)
                sizes.append(len(found))
                for term, times in Counter(found).items():
                    if asked[(at := digest(term) >> shift) >> 3] >> (at & 7) & 1:
                        blocks.setdefault(term, []).append((i, times, len(found)))
            # Numbers follow each other within a task, so a batch's first and a place in it name a row.
            first, offsets = batch.column(0)[0].as_py(), np.arange(batch.num_rows, dtype=np.uint32)
            rows = [(None, first, offsets.tobytes(), None, np.array(sizes, dtype=np.uint32).tobytes(), ids)]
            for term, held in blocks.items():
                at, tf, n = np.array(held, dtype=np.uint32).T
                rows.append((term.decode("utf-8"), first, offsets[at].tobytes(), tf.tobytes(), n.tobytes(), None))
            for start in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[start : start + 2_000]), kinds)], names=[x.split()[0] for x in LISTS.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x, dtype=np.uint32) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(int((x > 0).sum()) for x in found)]), pa.array([sum(int(x.sum(dtype=np.int64)) for x in found)])], names=["docs", "words"])


def scores(tf: np.ndarray, n: np.ndarray, w: int, docs: int, total: int) -> np.ndarray:
    """What a term of weight ``w`` adds to documents, in whole numbers."""
    m = 50 + 50 * n.astype(np.int64) * docs // total
    tf = tf.astype(np.int64)
    return w * (1_000_000_000 * tf // (1_000 * tf + 20 * m))


def _blocks(batch: pa.RecordBatch, docs: int, total: int, extra: list[str]) -> Iterator[tuple]:
    """Columns (batch, docs, tfs, ns, w, extra...) to (batch, documents' offsets, scores, extra...)."""
    for row in zip(*(batch.column(k).to_pylist() for k in ["batch", "docs", "tfs", "ns", "w", *extra])):
        at, tf, n = (np.frombuffer(x, dtype=np.uint32) for x in row[1:4])
        yield row[0], at, scores(tf, n, row[4], docs, total), *row[5:]


def _best(values: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(values, len(values) - k)[len(values) - k :] if len(values) > k else np.arange(len(values))


def _heads(batches: Iterator[pa.RecordBatch], k: int, docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """The k best postings of each list, of those that a task sees: (term, rid, s)."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for first, at, s, term in _blocks(batch, docs, total, ["term"]):
            rid = first + at.astype(np.int64)
            if term in held:
                rid, s = np.r_[held[term][0], rid], np.r_[held[term][1], s]
            best = _best(s, k)
            held[term] = rid[best], s[best]
    for names in (list(held)[i : i + 500] for i in range(0, len(held), 500)):
        many = [len(held[t][0]) for t in names]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), many).tolist(), pa.string()), pa.array(np.concatenate([held[t][0] for t in names])), pa.array(np.concatenate([held[t][1] for t in names]))], names=["term", "rid", "s"])


def _over(batches: Iterator[pa.RecordBatch], docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the queries that ask for them, an array of (query, least, bound), to what reaches ``least``: (query, batch, bound, docs, s)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["query", "batch", "bound", "docs", "s"]
    for batch in batches:
        rows = []
        for first, at, s, asked in _blocks(batch, docs, total, ["asked"]):
            order = np.argsort(-s, kind="stable")
            at, s = at[order], s[order]
            for q in asked:
                n = int(np.searchsorted(-s, -q["least"], side="right"))
                if n:
                    rows.append((q["query"], first, q["bound"], at[:n].tobytes(), s[:n].tobytes()))
                if len(rows) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query, batch, bound, docs, s, most, tau), sorted by query and batch, to documents that may be among the best k: (query, batch, doc, low, high).

    ``most`` is what all of a query's lists can add at most where nothing has come.
    """
    key, held, best = None, [], {}

    def done():
        query, batch, most, tau = key
        at = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x, _, _ in held])
        s = np.concatenate([np.frombuffer(x, dtype=np.int64) for _, x, _ in held])
        bound = np.repeat(np.array([x for _, _, x in held]), [len(x) // 8 for _, x, _ in held])
        doc, where = np.unique(at, return_inverse=True)
        low, known = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
        np.add.at(low, where, s)
        np.add.at(known, where, bound)
        high = low + most - known
        # The k-th best sum of those that the task has seen of a query: no better than that of all.
        seen = np.r_[best[1], low] if best and best[0] == query else low
        seen = seen[_best(seen, k)]
        if len(seen) == k:
            tau = max(tau, int(seen.min()))
        kept = np.flatnonzero(high >= tau)
        n = len(kept)
        return (query, seen), pa.RecordBatch.from_arrays([pa.array(np.full(n, query)), pa.array(np.full(n, batch)), pa.array(doc[kept].astype(np.int64)), pa.array(low[kept]), pa.array(high[kept])], names=["query", "batch", "doc", "low", "high"])

    for rows in batches:
        for query, batch, bound, docs, s, most, tau in zip(*(c.to_pylist() for c in rows.columns)):
            if key != (query, batch, most, tau):
                if held:
                    best, out = done()
                    yield out
                key, held = (query, batch, most, tau), []
            held.append((docs, s, bound))
    if held:
        yield done()[1]


def _looked_up(batches: Iterator[pa.RecordBatch], docs: int, total: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the documents wanted of them, an array of (query, doc), to (query, batch, doc, s)."""
    for batch in batches:
        query, where, doc, found = [], [], [], []
        for first, at, s, wanted in _blocks(batch, docs, total, ["wanted"]):
            mine = np.array([x["doc"] for x in wanted])
            place = np.minimum(np.searchsorted(at, mine), len(at) - 1)
            hit = np.flatnonzero(at[place] == mine)
            query += [wanted[i]["query"] for i in hit.tolist()]
            where += [first] * len(hit)
            doc += mine[hit].tolist()
            found += s[place[hit]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query, where, doc, found)], names=["query", "batch", "doc", "s"])


def _kth(sums: DataFrame, value: str, k: int) -> DataFrame:
    """(query, tau): the k-th best ``value`` of each query, for those that have k."""
    ranked = sums.select("query", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(value))).alias("r"), F.col(value).alias("tau"))
    return ranked.filter(F.col("r") <= k).filter(F.col("r") == k).select("query", "tau")


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for each row of ``queries`` (item_id, text): item_id, rank, doc_id, score.

    The score of a document is the sum over a query's distinct terms of ``scores``
    with the weight floor(1000 ln((2N+2) / (2df+1))); only scores above 0 count,
    equal ones go by doc_id, null first. Null and empty texts have no terms, very long ones are read
    whole; a repeated row of ``docs`` is a document of its own, repeated rows of
    ``queries`` are asked once, different texts of one item_id each for itself. Empty
    tables give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("query"), "*"), "search-queries")
    wanted = written(asked.select("query", "text").mapInArrow(_query_terms, "query long, term string, place long"), "search-terms")
    # At most 2^20 rows, whatever the queries.
    held = wanted.groupBy(F.shiftright("place", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(place & 7 as int))")).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    bitmap[np.array([r.byte for r in held], dtype=np.int64)] = np.array([r.bits for r in held], dtype=np.uint8)
    marks = spark.sparkContext.broadcast(bitmap)
    # Rows are numbered in the pass that writes them, and nothing reads the documents again.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = written(rows.mapInArrow(lambda it: _lists(it, marks.value), LISTS), "search-lists")
    about = lists.filter("term is null")
    n_docs, n_words = about.select("ns").mapInArrow(_counted, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    if not n_docs:
        n_docs = n_words = 1
    df = lists.filter("term is not null").groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = written(df.join(wanted.select("term").distinct(), "term").select("term", weight.cast("long").alias("w")).filter("w > 0"), "search-weights")
    blocks = lists.filter("term is not null").join(weights, "term").select("term", "batch", "docs", "tfs", "ns", "w")

    # Round 1
    tops = blocks.mapInArrow(lambda it: _heads(it, k, n_docs, n_words), "term string, rid long, s long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("s"), "rid"))
    heads = written(tops.select("term", "rid", "s", place.alias("r")).filter(F.col("r") <= k), "search-heads")
    pairs = wanted.select("query", "term").join(heads.filter("r = 1").select("term", F.col("s").alias("top")), "term")
    low = pairs.join(heads, "term").groupBy("query", "rid").agg(F.sum("s").alias("low"))
    tau = _kth(low, "low", k)
    sizes = pairs.groupBy("query").agg(F.count("*").alias("m"))
    # A document without a posting of ``least`` or more has less than tau, even if it is in every list.
    share = F.coalesce(F.ceil(F.col("tau") / F.col("m")), F.lit(1)).cast("long")
    least = sizes.join(tau, "query", "left").select("query", F.greatest(share, F.lit(1)).alias("least"), F.coalesce("tau", F.lit(1)).alias("tau"))
    plan = written(pairs.join(least, "query").select("query", "term", "least", "tau", F.least(F.col("least") - 1, "top").alias("bound")), "search-plan")

    # Round 2
    asks = plan.groupBy("term").agg(F.collect_list(F.struct("query", "least", "bound")).alias("asked"))
    come = blocks.join(asks, "term").select("batch", "docs", "tfs", "ns", "w", "asked").mapInArrow(lambda it: _over(it, n_docs, n_words), "query long, batch long, bound long, docs binary, s binary")
    most = plan.groupBy("query").agg(F.sum("bound").alias("most"), F.first("tau").alias("tau"))
    shares = max(16, ceil(about.count() / 64))  # of a query's batches, so that a task has about 64 of them however many there are
    dealt = come.join(broadcast_if_small(most, 100_000), "query").select("query", "batch", "bound", "docs", "s", "most", "tau")
    dealt = dealt.repartition(F.col("query"), F.floor(F.col("batch") / BATCH) % shares).sortWithinPartitions("query", "batch")
    sums = written(dealt.mapInArrow(lambda it: _sums(it, k), "query long, batch long, doc long, low long, high long"), "search-sums")
    better = _kth(sums, "low", k)
    candidates = sums.join(better, "query", "left").filter(F.col("high") >= F.coalesce("tau", F.lit(1))).select("query", "batch", "doc")

    # Round 3
    by_block = candidates.join(plan.select("query", "term"), "query").groupBy("term", "batch").agg(F.collect_list(F.struct("query", "doc")).alias("wanted"))
    exact = blocks.join(by_block, ["term", "batch"]).select("batch", "docs", "tfs", "ns", "w", "wanted").mapInArrow(lambda it: _looked_up(it, n_docs, n_words), "query long, batch long, doc long, s long")
    ids = about.select("batch", F.posexplode("ids").alias("at", "doc_id")).select(F.col("batch"), F.col("at").cast("long").alias("doc"), "doc_id")
    scored = exact.groupBy("query", "batch", "doc").agg(F.sum("s").alias("score")).filter("score > 0").join(ids, ["batch", "doc"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "batch", "doc"))
    return scored.select("query", "doc_id", "score", rank.alias("rank")).filter(F.col("rank") <= k).join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
