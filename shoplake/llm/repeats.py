"""Removing long strings that came before, by suffix arrays over what repeats.

Every window of ``length`` bytes names one of its grams as its anchor: the one that
is least in an order made of the gram alone, so equal windows have equal anchors
at equal places. Neighbouring windows with one anchor are a slice of the text.
Slices meet by their anchor in Spark, as digests first: of equal slices all but
the first are removed whole. Where one anchor has slices that differ, as at the
ends of a passage, their bytes follow, and ``suffixes.earlier`` sorts their
suffixes and says which windows an earlier slice holds.

Grams that are frequent in a sample of documents come last in the order, so a
common line is an anchor only of windows that hold little else, whose slices are
mostly equal. That deals rows evenly and changes no result, whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.store import written
from shoplake.llm.suffixes import earlier

#: Bits of a place within a chunk of text, which is what is looked at together; also bounds the memory of a worker.
CHUNK_BITS = 18
#: Bits of the bitmap of frequent grams, as a power of two: 2 MB.
HOT_BITS = 24
#: Slices of one anchor over this number are cut into ranges of NARROW windows and meet by what all of a range share.
MOST, NARROW = 1_000, 8

_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
NO_HOT = np.zeros(1 << (HOT_BITS - 6), dtype=np.uint64)


def gram_size(length: int) -> int:
    """Bytes of a gram: the largest power of two up to half the window."""
    return 1 << ((length // 2).bit_length() - 1)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes, a power of two, of ``data``."""
    x = (data.astype(np.uint64) + _ODD[2]) * _ODD[0]
    x ^= x >> np.uint64(29)
    n = 1
    while n < size:
        y = x[n:]
        x = x[:-n] * _ODD[1] + (y ^ (y >> np.uint64(31))) * _ODD[2]
        n *= 2
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    return x


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - HOT_BITS)).astype(np.int64)
    return hot[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)


def anchored(data: np.ndarray, valid: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first start, last start, anchor's place, anchor's hash). ``valid``: starts that count, in ascending order."""
    size = gram_size(length)
    h, w = grams(data, size), length - size + 1
    places = np.uint64((1 << CHUNK_BITS) - 1)
    least = (_is_hot(h, hot) << np.uint64(63)) | (h >> np.uint64(1) & ~places) | np.arange(len(h), dtype=np.uint64)
    n, wide = len(h) - w + 1, 1
    while wide * 2 <= w:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < w:
        least = np.minimum(least[:n], least[w - wide : w - wide + n])
    at = (least[valid] & places).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    last = np.r_[first[1:], len(at)] - 1
    return valid[first], valid[last], at[first], h[at[first]]


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts together, long ones in overlapping parts: (bytes, starts of windows within a text, text of each byte's part, what to add to a place to have that in its text)."""
    most = 1 << CHUNK_BITS
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def out():
        sizes = np.array([len(x[2]) for x in held])
        begins = np.cumsum(sizes) - sizes
        valid = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begins.tolist(), sizes.tolist())])
        return b"".join(x[2] for x in held), valid, begins, np.array([(x[0], x[1]) for x in held])

    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), most - length + 1):
            part = text[lo : lo + most]
            if len(part) < length:
                continue
            if total + len(part) > most:
                yield out()
                held, total = [], 0
            held.append((i, lo, part))
            total += len(part)
    if held:
        yield out()


def slices(texts: list[bytes], length: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Every slice of ``texts``: text, a (start), n (windows), pos (anchor), h (anchor's hash), s (digest of the slice)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "a", "n", "pos", "h", "s")}
    for data, valid, begins, parts in chunks(texts, length):
        lo, hi, pos, h = anchored(np.frombuffer(data, dtype=np.uint8), valid, length, hot)
        part = np.searchsorted(begins, lo, side="right") - 1
        move = parts[part, 1] - begins[part]
        s = np.array([digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())], dtype=np.uint64)
        for k, v in (("text", parts[part, 0]), ("a", lo + move), ("n", hi - lo + 1), ("pos", pos + move), ("h", h.view(np.int64)), ("s", s.view(np.int64))):
            found[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for k, v in found.items()}


def merged(doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts with those that overlap or touch made one."""
    if not len(doc):
        return doc, th, a, b
    order = np.lexsort((a, th, doc))
    doc, th, a, b = doc[order], th[order], a[order].astype(np.int64), b[order].astype(np.int64)
    other = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
    base = (np.cumsum(other) - 1) << 33
    reach = np.maximum.accumulate(b + base)
    first = np.flatnonzero(np.r_[True, a[1:] + base[1:] > reach[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    return doc[first], th[first], a[first], reach[last] - base[last]


PACKED = ["h", "s", "doc", "th", "pos", "back", "n"]
_KINDS = {"h": np.int64, "s": np.int64, "doc": np.int64, "th": np.int64, "pos": np.uint32, "back": np.uint8, "n": np.uint8, "sd": np.int64, "st": np.int64, "sa": np.uint32, "sb": np.uint32}
DEALT = "bucket int, " + ", ".join(f"{k} binary" for k in _KINDS)
FOUND = "doc long, th long, a long, b long, h long, pos long, narrow boolean"


def _split(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): slices by anchor, digest and place, and which of them are the first of their kind."""
    order = np.lexsort((c["pos"], c["th"], c["doc"], c["s"], c["h"]))
    h, s = c["h"][order], c["s"][order]
    return order, np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.empty(0, dtype=bool)


def _deal(batches: Iterator[pa.RecordBatch], length: int, parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc, th, text) to slices by anchor, a row for each bucket; all but the first of equal ones are spans already."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            c = slices([t.encode("utf-8") for t in batch.column(2).to_pylist()], length, hot)
            c |= {"doc": doc[c["text"]], "th": th[c["text"]], "back": c["pos"] - c["a"]}
            order, first = _split(c)
            # The same row twice is one slice twice, not a later one.
            again = order[~first]
            heads = order[np.flatnonzero(first)[np.cumsum(first) - 1][~first]]
            again = again[(c["doc"][again] != c["doc"][heads]) | (c["th"][again] != c["th"][heads]) | (c["pos"][again] != c["pos"][heads])]
            sd, st, sa, sb = merged(c["doc"][again], c["th"][again], c["a"][again], c["a"][again] + c["n"][again] + length - 1)
            kept = order[first]
            bucket = (c["h"][kept].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            kept, bucket = (x[np.argsort(bucket, kind="stable")] for x in (kept, bucket))
            home = (st.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            spans = np.argsort(home, kind="stable")
            ends, homes = np.searchsorted(bucket, np.arange(parts + 1)), np.searchsorted(home[spans], np.arange(parts + 1))
            rows = []
            for p in np.union1d(bucket, home).tolist():
                i, j = kept[ends[p] : ends[p + 1]], spans[homes[p] : homes[p + 1]]
                rows.append([p, *[c[k][i].astype(_KINDS[k]).tobytes() for k in PACKED], *[x[j].astype(_KINDS[k]).tobytes() for k, x in (("sd", sd), ("st", st), ("sa", sa), ("sb", sb))]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == "bucket" else pa.binary()) for k, x in zip(["bucket", *_KINDS], zip(*rows))], names=["bucket", *_KINDS])


def _rows(names: list[str], **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for lo in range(0, n, 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(columns[k][lo : lo + 20_000]) if k in columns else pa.nulls(min(n - lo, 20_000), pa.bool_() if k == "narrow" else pa.int64()) for k in names], names=names)


def _first_seen(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Dealt slices of a bucket to FOUND: spans (without h), and the first of each kind where an anchor has several kinds."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    held: dict[str, list[np.ndarray]] = {k: [] for k in _KINDS}
    for batch in batches:
        for k in _KINDS:
            held[k] += [np.frombuffer(x, dtype=_KINDS[k]) for x in batch.column(k).to_pylist()]
    if not held["h"]:
        return
    c = {k: np.concatenate(v) for k, v in held.items()}
    del held
    for k in ("pos", "back", "n", "sa", "sb"):
        c[k] = c[k].astype(np.int64)
    order, first = _split(c)
    h, doc, th, pos = (c[k][order] for k in ("h", "doc", "th", "pos"))
    start = pos - c["back"][order]
    end = start + c["n"][order] + length - 1
    if len(order):
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        late = np.flatnonzero(~first & ((doc != doc[head]) | (th != th[head]) | (pos != pos[head])))
    else:
        late = np.empty(0, dtype=np.int64)
    spans = merged(np.r_[c["sd"], doc[late]], np.r_[c["st"], th[late]], np.r_[c["sa"], start[late]], np.r_[c["sb"], end[late]])
    yield from _rows(names, doc=spans[0], th=spans[1], a=spans[2], b=spans[3])
    kinds = np.flatnonzero(first)
    if len(kinds):
        _, group, many = np.unique(h[kinds], return_inverse=True, return_counts=True)
        apart = kinds[many[group] > 1]
        yield from _rows(names, doc=doc[apart], th=th[apart], a=start[apart], b=end[apart], h=h[apart], pos=pos[apart], narrow=many[group][many[group] > 1] > most)


SLICES = "bucket int, key long, doc long, th long, a long, anchor long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, th, text, wanted) to the bytes of the slices that are wanted."""
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        for doc, th, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8")
            for w in wanted:
                h, pos, a, b = w["h"], w["pos"], w["a"], w["b"]
                if not w["narrow"]:
                    rows.append((h % parts, h, doc, th, a, pos - a, data[a:b]))
                    continue
                for r in range((pos - (b - length)) // NARROW, (pos - a) // NARROW + 1):
                    core = pos - NARROW * r
                    lo, hi = max(a, core - NARROW + 1), min(b, core + length)
                    key = xxhash.xxh3_64_intdigest(data[core : core - NARROW + 1 + length], r) - (1 << 63)
                    rows.append((key % parts, key, doc, th, lo, core - lo, data[lo:hi]))
            if len(rows) > 20_000:
                yield _sliced(rows)
                rows = []
        if rows:
            yield _sliced(rows)


def _sliced(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SLICES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == "bucket" else pa.binary() if k == "bytes" else pa.int64()) for k, x in zip(names, zip(*rows))], names=names)


def _later(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Slices of a bucket to spans that an earlier slice of the same anchor holds."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    key, doc, th, a, anchor = (rows.column(k).to_numpy() for k in ("key", "doc", "th", "a", "anchor"))
    order = np.lexsort((a, th, doc, key))
    key, doc, th, a, anchor = (x[order] for x in (key, doc, th, a, anchor))
    _, group, many = np.unique(key, return_inverse=True, return_counts=True)
    # A bounded number of slices at a time, whole groups together.
    bounds = np.cumsum(many)
    lo = 0
    while lo < len(key):
        hi = int(bounds[max(np.searchsorted(bounds, lo + 20_000, side="right") - 1, np.searchsorted(bounds, lo, side="right"))])
        part = np.arange(lo, hi)[many[group[lo:hi]] > 1]
        lo = hi
        if not len(part):
            continue
        at = a[part] + anchor[part]
        by = np.lexsort((at, th[part], doc[part]))
        places = np.empty(len(part), dtype=np.int64)
        places[by] = np.cumsum(np.r_[False, (doc[part][by][1:] != doc[part][by][:-1]) | (th[part][by][1:] != th[part][by][:-1]) | (at[by][1:] != at[by][:-1])])
        _, small = np.unique(group[part], return_inverse=True)
        row, start = earlier(small, rows.column("bytes").take(pa.array(order[part])).to_pylist(), anchor[part], places, length)
        d, t, x, y = merged(doc[part][row], th[part][row], a[part][row] + start, a[part][row] + start + length)
        yield from _rows(["doc", "th", "a", "b"], doc=d, th=t, a=x, b=y)


def _finish(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to results."""
    import hashlib

    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in whole.slice(at, 2000).columns)):
                data = text.encode("utf-8")
                kept, end, removed, runs = [], 0, 0, 0
                for span in sorted((s["a"], s["b"]) for s in spans or ()):
                    if not runs or span[0] > end:
                        kept.append(data[end : span[0]])
                        runs += 1
                        removed += span[1] - span[0]
                        end = span[1]
                    elif span[1] > end:
                        removed += span[1] - end
                        end = span[1]
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((doc_id, len(data), removed, runs, hashlib.sha256(rest).hexdigest(), *([rest] if keep else [])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=RESULT[: 5 + keep])


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def _frequent(texts: DataFrame, rows: int, length: int, sample: int = 2_000, share: float = 1 / 64) -> np.ndarray:
    """A bitmap of fixed size of grams that one in 300 documents of a sample or more has; it decides which grams are anchors, no result."""
    part = min(1.0, max(share, sample / max(1, rows)))
    least = max(8, int(rows * part / 300))
    size = gram_size(length)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(np.frombuffer(x, np.uint8), size)) for t in batch.column(0).to_pylist() if len(x := t.encode("utf-8")) >= length]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= max(2, least * batch.num_rows // max(1, int(rows * part)) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

    some = texts.filter(F.xxhash64("th").cast("double") < F.lit((part - 0.5) * 2.0**64)).select("text")
    common = some.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.shiftrightunsigned("h", 64 - HOT_BITS)
    words = common.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - HOT_BITS}) & 63 as int))")).alias("bits")).collect()
    hot = NO_HOT.copy()
    if words:
        hot[np.array([r.word for r in words])] = np.array([r.bits for r in words], dtype=np.int64).view(np.uint64)
    return hot


def without_repeats(docs: DataFrame, length: int = 100, keep: bool = False, most: int = MOST, bytes_per_part: int = 24_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` the bytes that stay.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier:
    in a smaller doc_id, or earlier in the same text. Strings are those of the input. A null text is an
    empty one; texts shorter than ``length`` stay whole. A null doc_id comes before all others; different texts
    of one doc_id are in an order of their own, by hash; of rows that are equal in both, one is the first and
    the others are its copies. Very long texts are cut in overlapping chunks of
    2^18 bytes and nothing is lost between them. Slices of an anchor that has more than ``most`` of them are cut
    finer, which changes no result. Other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / bytes_per_part))
    hot = spark.sparkContext.broadcast(_frequent(rows, n, length))
    long_enough = rows.filter(F.octet_length("text") >= length).select("doc", "th", "text")
    dealt = long_enough.mapInArrow(lambda it: _deal(it, length, parts, hot.value), DEALT).repartitionById(parts, F.col("bucket"))
    found = written(dealt.mapInArrow(lambda it: _first_seen(it, length, most), FOUND), "repeats-found")
    asked = found.filter("h is not null")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(asked.count() / 40_000))
    wanted = asked.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "pos", "a", "b", "narrow")).alias("wanted"))
    cut = long_enough.join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted").mapInArrow(lambda it: _cut(it, length, shares), SLICES)
    later = written(cut.repartitionById(shares, F.col("bucket")).mapInArrow(lambda it: _later(it, length), "doc long, th long, a long, b long"), "repeats-later")
    spans = found.filter("h is null").select("doc", "th", "a", "b").unionByName(later).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    # Of equal rows one is the first: it goes with the others, its copies are whole repeats.
    times = written(rows.groupBy("doc", "th").agg(F.count("*").alias("times")).filter("times > 1"), "repeats-times")
    several = rows.join(times, ["doc", "th"])
    once = rows.join(times, ["doc", "th"], "left_anti").unionByName(several.dropDuplicates(["doc", "th"]).select(rows.columns))
    firsts = once.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _finish(it, keep), result)
    size = F.octet_length("text").cast("long")
    gone = size >= length
    rest = F.when(gone, F.lit("")).otherwise(F.col("text")).cast("binary")
    copies = several.dropDuplicates(["doc", "th"]).select("doc_id", "text", F.explode(F.expr("sequence(2L, times)")).alias("time"))
    again = copies.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(0).cast("long").alias("n_spans"), F.sha2(rest, 256).alias("kept_sha256"), *([rest.alias("kept")] if keep else []))
    return firsts.unionByName(again)
