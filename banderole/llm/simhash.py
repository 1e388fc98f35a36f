"""SimHash near-duplicates through a vantage-point tree.

1. Every text gets a 64-bit fingerprint of its word shingles.  Equal fingerprints are one class.
2. A vantage-point tree over a bounded sample of classes deals all classes into shards: at a node
   with vantage point p and radius m, what lies within m of p goes left, the rest right.  For links
   at distance r or less the triangle inequality bounds what a branch can hold, so a class also
   visits the other side only where its distance is within r of the radius.  A pair that a node
   parts is found once, on the left side: right-hand homes within m + r visit it.
3. Each shard goes on splitting the same way in memory and compares leaves exactly, so all linked
   pairs of classes are met; it returns a spanning forest (at most one edge per class and shard),
   never all pairs.
4. Connected components of these edges name each group by its smallest document id.

The sample only steers balance: whatever it holds, the pairs found are exact.

Edge cases: null and empty texts have fingerprint zero and link like any other; rows with a null
id get their class's component and never name one; repeated ids give repeated rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_columns
from .components import connected_components
from .store import materialise

SEED = 42
LEAF = 768  # compared in full below this many homes


# --- fingerprints ------------------------------------------------------------------------------
def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    cuts = zip(starts.tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), dtype=np.uint64, count=len(words) - width + 1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is set where over half of the shingle hashes have it; zero without words."""
    return fingerprint_of(shingle_hashes(text or "", width))


def fingerprint_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, hashes.size, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key long, fp long): one row per document, the fingerprint's bits as a signed long."""

    def make():
        return lambda texts: [pa.array(np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))]

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t"))
    return with_columns(rows, "_t", [T.StructField("fp", T.LongType())], make, drop=("_t",))


# --- the tree ----------------------------------------------------------------------------------
@dataclass
class Node:
    """An inner node (vantage point, radius, two sides) or a leaf (shard number)."""

    shard: int = -1
    point: int = 0
    radius: int = 0
    left: Node | None = None
    right: Node | None = None


def distance(fps: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(point)).astype(np.int16)


def choose_split(fps: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage point, radius) for the most even of a few tries; None if all of ``fps`` are equal.

    A second round with more points and every radius is for lots that hardly part: there a small
    share is better than none.
    """
    best, found = 0.15, None
    for point in rng.choice(fps, size=min(4, fps.size), replace=False):
        d = distance(fps, point)
        radius = int(np.median(d))
        for r in (radius, radius - 1):
            share = float(np.mean(d <= r)) if r >= 0 else 0.0
            if min(share, 1 - share) > best:
                best, found = min(share, 1 - share), (int(point), r)
    if found is None:
        best = 0.0
        for point in rng.choice(fps, size=min(32, fps.size), replace=False):
            below = np.cumsum(np.bincount(distance(fps, point), minlength=65))[:64] / fps.size
            shares = np.minimum(below, 1 - below)
            if shares.max() > best:
                best, found = float(shares.max()), (int(point), int(shares.argmax()))
    return found


def build_tree(sample: np.ndarray, shards: int, seed: int = 0) -> tuple[Node, int]:
    """A tree of about ``shards`` leaves over the sample, and its leaf count."""
    rng, count = np.random.default_rng(seed), 0

    def grow(fps: np.ndarray, want: int) -> Node:
        nonlocal count
        split = choose_split(fps, rng) if want > 1 and fps.size >= 8 else None
        if split is None:
            count += 1
            return Node(shard=count - 1)
        near = distance(fps, split[0]) <= split[1]
        return Node(point=split[0], radius=split[1], left=grow(fps[near], want // 2), right=grow(fps[~near], want - want // 2))

    return grow(sample, shards), count


def sides(fps: np.ndarray, homes: np.ndarray, visits: np.ndarray, point: int, radius: int, r: int):
    """Index arrays (left homes, left visits, right homes, right visits) below a node."""
    dh, dv = distance(fps[homes], point), distance(fps[visits], point)
    near = dh <= radius
    crossing = homes[~near & (dh <= radius + r)]
    return homes[near], np.concatenate((visits[dv <= radius + r], crossing)), homes[~near], visits[dv > radius - r]


def route(tree: Node, fps: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, home indices, visitor indices) of every shard that some of ``fps`` reach."""
    stack = [(tree, np.arange(fps.size), np.zeros(0, dtype=np.int64))]
    while stack:
        node, homes, visits = stack.pop()
        if not homes.size and not visits.size:
            continue
        if node.shard >= 0:
            yield node.shard, homes, visits
            continue
        lh, lv, rh, rv = sides(fps, homes, visits, node.point, node.radius, r)
        stack += [(node.left, lh, lv), (node.right, rh, rv)]


# --- exact links in a shard --------------------------------------------------------------------
class Forest:
    """Union-find over 0..n-1 with vectorised look-ups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.parent[nodes]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                self.parent[nodes] = up
                return up
            up = higher

    def join(self, nodes: np.ndarray) -> None:
        roots = self.roots(nodes)
        self.parent[roots] = roots.min()


def _compare(fps: np.ndarray, queries: np.ndarray, homes: np.ndarray, r: int, forest: Forest) -> None:
    step = max(1, (1 << 20) // max(1, homes.size))
    targets = fps[homes]
    for k in range(0, queries.size, step):
        part = queries[k : k + step]
        hit = np.bitwise_count(fps[part][:, None] ^ targets[None, :]) <= r
        for i in np.flatnonzero(hit.sum(axis=1) > (1 if queries is homes else 0)):
            forest.join(np.append(homes[hit[i]], part[i]))


def link(fps: np.ndarray, home: np.ndarray, r: int, seed: int = 0) -> np.ndarray:
    """Component roots over a shard's classes: homes link with homes, visitors with homes."""
    rng, forest = np.random.default_rng(seed), Forest(fps.size)
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        homes, visits = stack.pop()
        if not homes.size:
            continue
        split = choose_split(fps[homes] if homes.size < 4096 else rng.choice(fps[homes], 4096), rng) if homes.size > LEAF else None
        if split is None:
            _compare(fps, homes, homes, r, forest)
            _compare(fps, visits, homes, r, forest)
            continue
        lh, lv, rh, rv = sides(fps, homes, visits, *split, r)
        if not lh.size or not rh.size:
            _compare(fps, homes, homes, r, forest)
            _compare(fps, visits, homes, r, forest)
            continue
        stack += [(lh, lv), (rh, rv)]
    return forest.roots(np.arange(fps.size))


# --- the distributed join ----------------------------------------------------------------------
def links(classes: DataFrame, *, radius: int = 2, shard_size: int = 4096, most_shards: int = 32_768) -> DataFrame:
    """(u, v) edges that connect exactly the classes within ``radius`` bits of each other.

    ``classes``: distinct (fp long, rep long).  The tree is fitted on at most 16 * ``most_shards``
    sampled fingerprints (4 MB), so that its size on the driver is bounded; nothing is left out by
    that bound: past 134 million classes a shard takes more of them (17 bytes each and visit) and
    splits further in its task, down to the same leaves.
    """
    n = classes.count()
    shards = min(most_shards, max(1, -(-n // shard_size)))
    sampled = classes.orderBy(F.xxhash64("fp"), "fp").limit(16 * shards).select("fp").toPandas()["fp"] if shards > 1 else pd.Series([], dtype="int64")
    tree, _ = build_tree(sampled.to_numpy(dtype=np.int64).view(np.uint64), shards)
    shared = classes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for shard, homes, visits in route(shared.value, fps, radius):
                at = np.concatenate((homes, visits))
                yield pd.DataFrame({"shard": shard, "fp": b["fp"].to_numpy()[at], "rep": b["rep"].to_numpy()[at], "home": np.arange(at.size) < homes.size})

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep = pdf["rep"].to_numpy()
        root = link(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), pdf["home"].to_numpy(dtype=bool), radius)
        tied = root != np.arange(root.size)
        return pd.DataFrame({"u": rep[tied], "v": rep[root[tied]]})

    dealt = classes.mapInPandas(deal, "shard int, fp long, rep long, home boolean")
    return dealt.groupBy("shard").applyInPandas(connect, "u long, v long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, shard_size: int = 4096) -> DataFrame:
    """(key, fp long, component_id): the group of each document, named by its smallest id."""
    fps = materialise(fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("key").alias("rep")), "classes")
    named = classes.where("rep is not null")
    groups = connected_components(links(named, radius=radius, shard_size=shard_size))
    of_class = classes.join(groups, classes["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_class, "fp").select("key", "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the near-duplicates of an earlier document (by id); null ids stay."""
    return without_later(docs, near_duplicates(docs, key=key, text=text, **kw), key)


def without_later(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``docs`` without those whose group, by (key, component_id), has an earlier id."""
    gone = groups.where("key <> component_id").select(F.col("key").alias(key)).distinct()
    return docs.join(gone, key, "left_anti")
