"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Window k (one sequence by default) gives each
queue credit in proportion to its target share; what a queue could not spend,
being whole tokens only, is its deficit and is carried into the next window. A
queue that runs dry leaves its share to the others.

The deficits have a closed form. With shares a_s and queue lengths T_s, credit
runs as the fluid F(v) = sum_s min(T_s, a_s * v); token x of queue s is due at
v = (2x + 1) / (2 a_s), and window k holds the tokens that are due among the
first L(k+1) but not the first Lk. So any task can start at any window with the
very deficits that serial rounds would have left: they are carried across
windows and partitions without a serial pass, and no task sees a whole queue.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplake.functions.cluster import broadcast_if_small
from shoplake.llm.bpe import encoder
from shoplake.llm.store import written

PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = "doc_id long, source string, ids binary, n long, part int, local_start long"


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, part, served = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
    end = np.array([end_id], dtype="<u2").tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            rows = batch.slice(lo, 1000)
            sources = rows.column(1).to_pylist()
            ids = [enc.ids(t or "") + end for t in rows.column(2).to_pylist()]
            n = [len(x) // 2 for x in ids]
            starts = []
            for s, k in zip(sources, n):
                starts.append(served[s])
                served[s] += k
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64())],
                names=["doc_id", "source", "ids", "n", "part", "local_start"],
            )


class Schedule:
    """Where each window cuts each queue. A queue may be a pool with a schedule of its own: ``pools`` by queue."""

    def __init__(self, totals: list[int], shares: list[float], window: int, pools: dict[int, Schedule] | None = None):
        self.window = window
        self.totals = np.array(totals, dtype=np.int64)
        self.shares = np.array(shares, dtype=np.float64)
        self.pools = pools or {}
        dry = [np.delete(self.totals / self.shares, list(self.pools)), *(p._v for p in self.pools.values())]
        self._v = np.unique(np.concatenate([[0.0], *dry]))
        self._f = np.zeros(len(self._v))
        for queue in range(len(self.totals)):
            self._f += self._spent(queue, self._v)
        self.tokens = int(self.totals.sum())

    def _spent(self, queue: int, v: np.ndarray) -> np.ndarray:
        pool = self.pools.get(queue)
        return np.interp(v, pool._v, pool._f) if pool else np.minimum(self.totals[queue], self.shares[queue] * v)

    def fluid(self, queue: int, x: float) -> float:
        """Tokens of all queues that are due before token x of ``queue``, within the number of queues."""
        pool = self.pools.get(queue)
        v = np.interp(x + 0.5, pool._f, pool._v) if pool else (x + 0.5) / self.shares[queue]
        return float(np.interp(v, self._v, self._f))

    def at(self, goal: np.ndarray) -> np.ndarray:
        """Row i: tokens of each queue among the first ``goal[i]`` of all."""
        v = np.interp(np.maximum(goal - len(self.totals) / 2, 0), self._f, self._v)
        taken = np.clip(np.ceil(np.outer(v, self.shares) - 0.5), 0, self.totals).astype(np.int64)
        for queue in self.pools:
            taken[:, queue] = np.clip(np.ceil(self._spent(queue, v) - 0.5), 0, self.totals[queue])
        left = goal - taken.sum(axis=1)
        while (open_ := np.flatnonzero(left > 0)).size:
            now = taken[open_]
            due = (2 * now + 1) / (2 * self.shares)
            for queue, pool in self.pools.items():
                due[:, queue] = np.interp(now[:, queue] + 0.5, pool._f, pool._v)
            taken[open_, np.where(now < self.totals, due, np.inf).argmin(axis=1)] += 1
            left[open_] -= 1
        return taken

    def cuts(self, first: int, last: int) -> np.ndarray:
        """Row i: tokens of each queue in all windows before ``first + i``."""
        return self.at(np.minimum(np.arange(first, last + 1, dtype=np.int64) * self.window, self.tokens))


class Sources:
    """A queue for every source: a tree of schedules of at most ``fan`` queues each.

    A pool's curve is the sum of its sources' curves, so a source that runs dry
    leaves its share to all others, and every level adds less than a token or
    two to a source's deficit for each queue of its schedule.
    """

    def __init__(self, totals: list[int], shares: list[float], window: int, fan: int = 64):
        self.window = window
        self._paths: list[list[tuple[Schedule, int]]] = [[] for _ in totals]

        def grow(items: np.ndarray) -> Schedule:
            parts = np.array_split(items, min(len(items), max(fan, 2)))
            pools = {i: grow(p) for i, p in enumerate(parts) if len(p) > 1}
            plan = Schedule([sum(totals[k] for k in p) for p in parts], [sum(shares[k] for k in p) for p in parts], window, pools)
            for i, p in enumerate(parts):
                for k in p:
                    self._paths[k].insert(0, (plan, i))
            return plan

        self.tokens = grow(np.arange(len(totals))).tokens

    def windows(self, source: int, lo: int, hi: int) -> tuple[int, int]:
        """First and last window that tokens lo to hi of ``source`` can be in."""
        a, b = float(lo), float(hi)
        for plan, queue in reversed(self._paths[source]):
            slack = len(plan.totals) + 1
            a, b = max(0.0, plan.fluid(queue, a) - slack), plan.fluid(queue, b) + slack
        return int(a // self.window), int(b // self.window) + 1

    def cuts(self, source: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of ``source`` before each window, and where in each window its piece starts."""
        before = np.zeros(last - first, dtype=np.int64)
        mine = np.minimum(np.arange(first, last + 1, dtype=np.int64) * self.window, self.tokens)
        for plan, queue in self._paths[source]:
            cuts = plan.at(mine)
            before += np.diff(cuts, axis=0)[:, :queue].sum(axis=1)
            mine = cuts[:, queue]
        return mine, before


def _cut(batches: Iterator[pa.RecordBatch], schedule: Sources, block: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, source, ids, n, queue, start) to pieces."""
    for batch in batches:
        queue, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 3))
        order = np.lexsort((start, queue))
        new = np.ones(len(order), dtype=bool)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            new[1:] = (queue[a] != queue[b]) | (start[a] + n[a] != start[b])
        for rows in np.split(order, np.flatnonzero(new)[1:]) if len(order) else ():
            q, begins = int(queue[rows[0]]), start[rows]
            lo, hi = int(begins[0]), int(begins[-1] + n[rows[-1]])
            ids = memoryview(np.frombuffer(b"".join(batch.column(2)[int(r)].as_py() for r in rows), dtype="<u2").astype("<u4").tobytes())
            first, last = schedule.windows(q, lo, hi)
            for k in range(first, last + 1, block):
                mine, before = schedule.cuts(q, k, min(k + block, last + 1))
                x0, x1 = max(lo, int(mine[0])), min(hi, int(mine[-1]))
                if x0 >= x1:
                    continue
                points = np.unique(np.concatenate([[x0, x1], begins[(begins > x0) & (begins < x1)], mine[(mine > x0) & (mine < x1)]]))
                x, length = points[:-1], np.diff(points)
                doc = np.searchsorted(begins, x, side="right") - 1
                win = np.searchsorted(mine, x, side="right") - 1
                at = rows[doc]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((points[:-1] - lo).tolist(), (points[1:] - lo).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(x - begins[doc]), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[at]), pa.array(win + k), pa.array(before[win] + x - mine[win])],
                    names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )


def pack(docs: DataFrame, shares: dict[str, float] | None = None, sequence: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1, max_queues: int = 64, temperature: float = 1.0) -> DataFrame:
    """Pack whole documents (doc_id, source, text) into windows of ``sequence`` tokens.

    ``shares`` gives target proportions by source; without it a queue's share is
    its token total to the power 1/``temperature``. Every source has a queue; of
    more than ``max_queues`` sources the queues form a tree. One row per piece; only the last sequence
    is short. Null text counts as empty (one end token), null source is a
    source of its own, repeated rows are packed as often as they come, extra
    columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    encoded = written(rows.mapInArrow(lambda it: _encode(it, vocabulary, end_id), ENCODED), "packing-ids")
    spent = encoded.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    sources = [(r.source, r.tokens) for r in spent.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "source").collect()]
    if not sources:
        return spark.createDataFrame([], PIECES)
    totals, names = [t for _, t in sources], [s for s, _ in sources]
    weights = [t ** (1 / temperature) for t in totals]
    if shares:
        weights = [max(shares.get(s, 0.0), 1e-9) for s in names]
    all_weights = sum(weights)
    schedule = Sources(totals, [w / all_weights for w in weights], sequence, max_queues)
    queues = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, queue int")
    queued = spent.join(broadcast_if_small(queues, 1_000_000), "source")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = queued.select("source", "part", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    placed = encoded.join(broadcast_if_small(offsets, 1_000_000), ["source", "part"]).select("doc_id", "source", "ids", "n", "queue", (F.col("before") + F.col("local_start")).alias("start"))
    return placed.mapInArrow(lambda it: _cut(it, schedule), PIECES)
