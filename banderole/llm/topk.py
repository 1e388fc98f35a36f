"""Exact top-k search by block-at-a-time pruning.

A vector is a bag of terms, its components, scaled to whole numbers: floor(scale * x).  Consecutive
rows make document-range blocks.  A block holds its forward index, the matrix of its vectors, and for every term the greatest and
least weight.  The bound of a block for a query is the sum over terms of the greater of weight times maximum and
weight times minimum: no vector in the block scores higher, also with negative weights.

A query takes the blocks in the order of its bounds, scores whole blocks through their forward
indexes and stops where the next bound falls below its k-th score.  An equal bound goes on, since equal scores go by id.
Rounds of 1, 1, 2, 4 ... blocks a query let queries that want the same block score it in one matrix product.

Queries are dealt into groups of about ``GROUP`` and blocks into stripes; a task has one group and
one stripe, holds the group with its best k so far, and passes over the stripe's blocks in buffers of ``BUFFER``, so its
memory doesn't grow with the table; thresholds carry from buffer to buffer.  A row of the blocks goes out once a query group,
and each group gets k rows a query from every stripe, of which the best k stay.
Nothing is broadcast, and no pair of rows is ever a row.

Edge cases: vectors that are null or hold a null, NaN or infinite component take no part, neither do rows without an
id; a vector shorter than another has zeros for what it lacks; an empty one scores 0.  A row is never the answer
to a query of its own id; repeated ids each count, as queries and as candidates.  Weights and sums are exact at any size: beyond
2**53 blocks are scored in whole numbers of any length, and a score that a long can't hold is shown as the nearest long, in
the order of the true ones.  No rows or no queries give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import quoted, slices
from .store import materialise, shuffle_partitions

BLOCK = 256
GROUP = 8192
BUFFER = 64
#: Whole numbers up to this are exact as doubles, and so are their sums in any order.
EXACT = 2.0**53
LONG = 2**63 - 1

FOUND = "query_id long, copy long, vec_id long, score long, beyond long, fine string"
BLOCKS = "part int, seq int, kind int, size int, body binary"


def scaled(rows: list[list[float]], scale: float) -> np.ndarray:
    """One row of whole numbers for each vector, padded with zeros: doubles where these are exact, else Python integers."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if np.abs(out).max(initial=0) < EXACT:
        return out
    from fractions import Fraction

    return np.array([[math.floor(Fraction(scale) * Fraction(x)) for x in r] + [0] * (width - len(r)) for r in rows], dtype=object)


def sortable(x: int) -> str:
    """Text in the order of the numbers."""
    digits = str(abs(x))
    if x >= 0:
        return f"1{len(digits):09d}{digits}"
    return "0" + f"{len(digits):09d}{digits}".translate(str.maketrans("0123456789", "9876543210"))


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.concatenate([m, np.zeros((len(m), width - m.shape[1]), dtype=m.dtype)], axis=1)


def _top(m: np.ndarray) -> float | int:
    return np.abs(m).max(initial=0)


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(queries, blocks): the greatest score that a vector between ``least`` and ``most`` can have."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


class Best:
    """The best k so far of each query: scores falling, equal ones by id."""

    def __init__(self, queries: int, k: int, kind: type):
        self.k, self.lowest = k, -math.inf
        self.scores = np.full((queries, k), self.lowest, dtype=kind)
        self.ids = np.full((queries, k), LONG, dtype=np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries ``which`` against rows ``ids``; what can't come in is left out at once."""
        low, last = self.kth()[which][:, None], self.ids[which, -1][:, None]
        i, j = np.nonzero(((scores > low) | ((scores == low) & (ids[None, :] < last))) & (ids[None, :] != own[which][:, None]))
        self.rest.append((which[i], scores[i, j], ids[j]))
        self.waiting += i.size
        if self.waiting > 1_000_000:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            self.rest = []
            return
        touched = np.unique(np.concatenate([r[0] for r in self.rest]))
        q = np.concatenate([*(r[0] for r in self.rest), np.repeat(touched, self.k)])
        s = np.concatenate([*(r[1] for r in self.rest), self.scores[touched].ravel()])
        d = np.concatenate([*(r[2] for r in self.rest), self.ids[touched].ravel()])
        rank = np.unique(s, return_inverse=True)[1] if s.dtype == object else s
        order = np.lexsort((d, -rank, q))
        q, s, d = q[order], s[order], d[order]
        place = np.arange(q.size) - np.searchsorted(q, q)
        in_front = place < self.k
        self.scores[q[in_front], place[in_front]] = s[in_front]
        self.ids[q[in_front], place[in_front]] = d[in_front]
        self.rest, self.waiting = [], 0


def search_buffer(q: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], best: Best) -> int:
    """Score the blocks of a buffer that queries still need, best bounds first; how many (query, block) were scored."""
    width = max([q.shape[1], *(m.shape[1] for _, m in blocks)])
    q, mats = _widened(q, width), [_widened(m, width) for _, m in blocks]
    tops = [_top(m) for m in mats]
    if not (q.dtype == object or any(m.dtype == object for m in mats)) and float(_top(q)) * float(max(tops)) * width >= EXACT:
        q = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape)
    if q.dtype == object or any(m.dtype == object for m in mats):
        q, *mats = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (q, *mats))
        best.scores = best.scores.astype(object)
    high = bounds(q, np.stack([m.max(axis=0) for m in mats]), np.stack([m.min(axis=0) for m in mats]))
    order = np.argsort(-high, axis=1, kind="stable")
    at, step, scored = 0, 1, 0
    alive = np.arange(len(q))
    while at < len(blocks) and alive.size:
        wanted = order[alive, at : at + step]
        needed = np.take_along_axis(high[alive], wanted, axis=1) >= best.kth()[alive][:, None]
        for b in np.unique(wanted[needed]):
            which = alive[(needed & (wanted == b)).any(axis=1)]
            scored += which.size
            best.offer(which, q[which] @ mats[b].T, blocks[b][0], own)
        best.settle()
        at += step
        step = at  # rounds of 1, 1, 2, 4 ... blocks
        if at < len(blocks):
            alive = alive[high[alive, order[alive, at]] >= best.kth()[alive]]
    return scored


def _packed(rows: DataFrame, scale: float, block: int) -> DataFrame:
    """Blocks of consecutive rows (kind 1) and of the queries among them (kind 0)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, list[float]]]] = {0: [], 1: []}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal seq
            ids, vectors = zip(*held[kind])
            m = scaled(list(vectors), scale)
            small = np.int16 if m.dtype != object and _top(m) < 2**15 else m.dtype
            body = pickle.dumps((np.array(ids, dtype=np.int64), m.astype(small)), protocol=5)
            held[kind], seq = [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (kind, pa.int32()), (len(ids), pa.int32()), (body, pa.binary()))], names=["part", "seq", "kind", "size", "body"])

        for b in batches:
            for s in slices(b):
                for i, v, ask in zip(s.column("id").to_pylist(), s.column("v").to_pylist(), s.column("ask").to_pylist()):
                    for kind in (1, 0) if ask else (1,):
                        held[kind].append((i, v))
                        if len(held[kind]) == block:
                            yield flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind)

    return rows.mapInArrow(pack, BLOCKS)


def search(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, block: int = BLOCK, group: int = GROUP, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each row where ``queries`` holds, over all other rows."""
    spark = vectors.sparkSession
    v = F.transform(F.col(quoted(vector)), lambda x: x.cast("double"))
    rows = vectors.select(F.col(quoted(key)).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("ask"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    table = materialise(_packed(rows, scale, block), "topk-blocks")
    sizes = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("size").alias("rows"), F.count("*").alias("blocks")).collect()}
    asked = sizes[0]["rows"] if 0 in sizes else 0
    groups = max(1, -(-asked // group))
    wanted = cells or 3 * shuffle_partitions(spark)
    stripes = max(1, min(-(-wanted // groups), -(-sizes[1]["blocks"] // 4) if 1 in sizes else 1))
    place = F.xxhash64("part", "seq")
    dealt = table.withColumns({"own": F.pmod(place, F.lit(groups)), "stripe": F.pmod(place, F.lit(stripes))})
    ask, doc = F.col("kind") == 0, F.col("kind") == 1
    span = F.when(ask, F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: F.col("own") * stripes + s)).when(doc, F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * stripes + F.col("stripe")))
    spread = dealt.select(F.explode(span.cast("array<bigint>")).alias("cell"), "kind", "part", "seq", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: int | None = None
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        buffer: list[tuple[np.ndarray, np.ndarray]] = []
        state: tuple[np.ndarray, np.ndarray, Best] | None = None

        def drain() -> None:
            nonlocal state, buffer
            if state is None and asked:
                width = max(m.shape[1] for _, m in asked)
                q = np.concatenate([_widened(m, width) for _, m in asked])
                own = np.concatenate([i for i, _ in asked])
                state = q, own, Best(len(q), k, q.dtype if q.dtype == object else np.float64)
            if state is not None and buffer:
                search_buffer(state[0], state[1], buffer, state[2])
            buffer = []

        def result() -> Iterator[pa.RecordBatch]:
            drain()
            if state is None:
                return
            _, own, best = state
            i, j = np.nonzero(best.scores > best.lowest)
            scores, ids = best.scores[i, j], best.ids[i, j]
            beyond = np.array([(x > LONG) - (x < -LONG - 1) for x in scores], dtype=np.int64) if scores.dtype == object else np.zeros(i.size, np.int64)
            for at in range(0, i.size, 50_000):
                s = slice(at, at + 50_000)
                shown = [max(-LONG - 1, min(LONG, int(x))) for x in scores[s]]
                fine = [sortable(int(x)) if y else None for x, y in zip(scores[s], beyond[s])]
                columns = (own[i[s]], i[s] + ((cell // stripes) << 32), ids[s], pa.array(shown, pa.int64()), beyond[s], pa.array(fine, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

        for b in batches:
            for c, kind, body in zip(b.column("cell").to_pylist(), b.column("kind").to_pylist(), b.column("body")):
                if c != cell:
                    yield from result()
                    cell, asked, buffer, state = c, [], [], None
                ids, m = pickle.loads(body.as_py())
                m = m if m.dtype == object else m.astype(np.float64)
                (asked if kind == 0 else buffer).append((ids, m))
                if len(buffer) == BUFFER:
                    drain()
        yield from result()

    parts = max(1, min(groups * stripes, 4 * shuffle_partitions(spark)))
    sorted_cells = spread.repartition(parts, "cell").sortWithinPartitions("cell", "kind", "part", "seq").select("cell", "kind", "body")
    found = sorted_cells.mapInArrow(run, FOUND)
    # a query keeps its place in its group in every stripe, so (query_id, copy) tells repeated ids apart
    first = W.partitionBy("query_id", "copy").orderBy(F.desc("beyond"), F.desc("score"), F.desc("fine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
