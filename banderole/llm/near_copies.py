"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's stage.

1. Texts with equal shingle sets are one class, named by a 64-bit hash of the set (among n classes
   about n * n / 2 ** 65 share a name: none to speak of below a thousand million).
2. Every class gets the SimHash fingerprint of its set, and ``simhash``'s vantage-point tree links
   fingerprints within ``radius`` bits: a forest, about one pair a class, never all pairs of a group.
3. What lies further apart meets by ``bands * rows`` minimum hashes: classes that agree in a whole
   band. A class is paired with the likeliest member that isn't of its group, one pair a class.
4. The paired texts' shingle sets are compared in full: only a Jaccard similarity of ``percent``
   / 100 or more links. Connected components of the links are groups, after step 2 and after step 3.
5. Meetings that still hold several groups are settled where they meet: every pair of members of
   two groups that sketches of their whole sets (the least hash in each of ``BINS`` bins) call
   likely is compared exactly, two classes in the first band that they share alone. Only a link that
   joins two groups leaves the task, so rows grow with members, not with pairs of them.

Steps 2 and 3 propose, steps 4 and 5 decide, so no link is false, and every likely pair of a meeting
is either compared or already within one group.  A group is named by its smallest document id.  Two
texts of similarity s miss each other's bands with a chance of (1 - s ** rows) ** bands: 3e-5 at 0.8
with 20 bands of 4, less above.

A meeting is cut into parts of ``HELD`` bytes and each pair of parts is a cell of its own, so a task
of step 5 holds one part, however many members agree; it streams the other. Step 3 holds a meeting's
sketches, about 620 bytes a class; equal texts count once.  Members that resemble each other and
don't link are compared pair by pair: that time is quadratic by nature, its memory and rows aren't.

Similarity 0.8 alone by the tree would need radius 14, at which the triangle inequality hardly
prunes (figures in the README), so its radius is small and the bands take what it can't reach.

Edge cases: null and empty texts have no shingles and are copies of each other; shorter texts than
a shingle are one shingle; rows with a null id get their group's name and never give one (a group
without any id has none); repeated ids give repeated rows, each in its own text's group; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_columns
from .components import connected_components
from .simhash import fingerprint_of, links, shingle_hashes, without_later
from .store import materialise, shuffle_partitions

BINS = 512
LIKELY = 0.73  # estimated similarity: 4 deviations below 0.8 for sets that fill the bins, more for others
WIDE = 4  # bytes of a band key in a signature: two classes that don't share a band seem to with a chance of 2 ** -32
HELD = 64 << 20
AT_ONCE = 64  # sets compared in one go


def minima(hashes: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """``count`` minimum hashes of a set of 64-bit hashes."""
    rng = np.random.default_rng(seed)
    flips, odd = rng.integers(0, 1 << 64, count, dtype=np.uint64), rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)
    least = np.full(count, np.uint64((1 << 64) - 1))
    for k in range(0, hashes.size, 2048):
        x = (hashes[None, k : k + 2048] ^ flips[:, None]) * odd[:, None]
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * odd[:, None]).min(axis=1))
    return least


def class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def marks(docs: DataFrame, *, key: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(key, cls, bands, sig, fp) of each document: class, band keys, ``WIDE`` bytes of each of them, fingerprint."""

    def make():
        def of(texts: list[str]) -> list[pa.Array]:
            cls, keys, sigs, fps = [], [], [], []
            for t in texts:
                hashes = np.unique(shingle_hashes(t, shingle))
                cls.append(class_of(hashes))
                fps.append(fingerprint_of(hashes))
                least = minima(hashes, bands * rows)
                named = [xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(least.reshape(bands, rows))] if hashes.size else []
                sigs.append(np.array(named, dtype=np.uint64).astype("<u4").tobytes())
                keys.append([x - (1 << 63) for x in named])
            return [pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]

        return of

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t"))
    added = [T.StructField("cls", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()), T.StructField("fp", T.LongType())]
    return with_columns(chosen, "_t", added, make, drop=("_t",))


def sketch_of(hashes: np.ndarray) -> bytes:
    """A byte of the least hash in each bin, zero where there is none; ``hashes`` are sorted."""
    bins = (hashes >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1])) if bins.size else bins
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = (hashes[first] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


class Meeting:
    """The members of a meeting, by band ``at``, that a task holds, and their groups as links join them."""

    def __init__(self, at: int, wide: int, width: int):
        self.at, self.wide, self.n, self.renamed = at, wide, 0, {}
        self.keys, self.groups, self.sizes = (np.zeros(8, dtype=np.int64) for _ in range(3))
        self.sigs, self.sketches = np.zeros((8, width), dtype=np.uint8), np.zeros((8, BINS), dtype=np.uint8)
        self.sets: list[np.ndarray] = []

    def hold(self, key: int, group: int, sig: np.ndarray, sketch: np.ndarray, hashes: np.ndarray | None = None) -> None:
        n = self.n
        if n == self.keys.size:
            self.keys, self.groups, self.sizes, self.sigs, self.sketches = (np.concatenate((x, x)) for x in (self.keys, self.groups, self.sizes, self.sigs, self.sketches))
        self.keys[n], self.groups[n], self.sigs[n], self.sketches[n] = key, self.group_of(group), sig, sketch
        if hashes is not None:
            self.sizes[n] = hashes.size
            self.sets.append(hashes.copy())  # not a view of a whole batch
        self.n += 1

    def group_of(self, group: int) -> int:
        """The group's name by now."""
        last = group
        while last in self.renamed:
            last = self.renamed[last]
        if last != group:
            self.renamed[group] = last
        return last

    def likely(self, near: np.ndarray, sig: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """Those of the members ``near`` that look similar and share no earlier band, the likeliest first."""
        members = self.sketches[near]
        alike = ((members == sketch) & (sketch > 0)).sum(axis=1) / np.maximum(((members | sketch) > 0).sum(axis=1), 1)
        near, alike = near[alike >= LIKELY], alike[alike >= LIKELY]
        if self.at and near.size:  # met in an earlier band already
            before = (self.sigs[near, : self.at * self.wide] == sig[: self.at * self.wide]).reshape(near.size, self.at, self.wide)
            first = ~before.all(axis=2).any(axis=1)
            near, alike = near[first], alike[first]
        return near[np.lexsort((self.keys[near], -alike))]

    def pairs(self, group: int, sig: np.ndarray, sketch: np.ndarray, most: int) -> list[int]:
        """At most ``most`` members of other groups, to compare a newcomer of ``group`` with."""
        return self.keys[self.likely(np.flatnonzero(self.groups[: self.n] != group), sig, sketch)[:most]].tolist()

    def links(self, group: int, sig: np.ndarray, sketch: np.ndarray, hashes: np.ndarray, percent: int) -> list[int]:
        """A member of each other group that a newcomer is similar to; those groups are one from then on."""
        mine, groups, sizes, out = self.group_of(group), self.groups[: self.n], self.sizes[: self.n], []
        fit = 100 * np.minimum(sizes, hashes.size) >= percent * np.maximum(sizes, hashes.size)
        near = self.likely(np.flatnonzero((groups != mine) & fit), sig, sketch)
        for k in range(0, near.size, AT_ONCE):
            part = near[k : k + AT_ONCE]
            part = part[groups[part] != mine]
            if not part.size:
                continue
            flat = np.concatenate([self.sets[m] for m in part])
            found = hashes[np.minimum(hashes.searchsorted(flat), hashes.size - 1)] == flat
            shared = np.add.reduceat(found.astype(np.int64), np.append(0, np.cumsum(sizes[part])[:-1]))
            for m in part[(100 + percent) * shared >= percent * (sizes[part] + hashes.size)]:  # shared / union >= percent / 100
                theirs = int(groups[m])
                if theirs != mine:
                    out.append(int(self.keys[m]))
                    self.renamed[theirs] = mine
                    groups[groups == theirs] = mine
        return out


def bytes_of(*columns: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint8) for x in columns]


def batch_of(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def candidates(met: DataFrame, wide: int, most: int) -> DataFrame:
    """(u, v) distinct pairs of classes of different groups that may be similar: ``most`` a class and band.

    ``met``: (band, at, key, group, sig, sketch), ``wide`` bytes a band in sig.
    """
    names = ["band", "at", "key", "group", "sig", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, meeting = None, None
        for b in batches:
            u, v = [], []
            for band, at, key, group, sig, sketch in zip(*(b[c].to_pylist() for c in names)):
                if band != before:
                    before, meeting = band, Meeting(at, wide, len(sig))
                member = bytes_of(sig, sketch)
                others = meeting.pairs(group, *member, most)
                meeting.hold(key, group, *member)
                u += [key] * len(others)
                v += others
            yield batch_of(u, v)

    dealt = met.repartition(shuffle_partitions(met.sparkSession), "band").sortWithinPartitions("band", "key")
    return dealt.select(*names).mapInArrow(run, "u long, v long").distinct()


def settle(met: DataFrame, sets: DataFrame, wide: int, percent: int, held: int = HELD) -> DataFrame:
    """(u, v) links between groups that meet, all that it takes to join those that belong together.

    ``met``: (band, at, key, group, sig), ``sets``: (key, hashes, sketch).  A task holds about
    ``held`` bytes of a meeting.
    """
    names = ["band", "home", "other", "part", "at", "key", "group", "sig", "sketch", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, cell = None, None
        for b in batches:
            u, v = [], []
            sets = b["hashes"]
            for i, (band, home, other, part, at, key, group, sig, sketch) in enumerate(zip(*(b[c].to_pylist() for c in names[:-1]))):
                if (band, home, other) != before:
                    before, cell = (band, home, other), Meeting(at, wide, len(sig))
                member = [*bytes_of(sig, sketch), sets[i].values.to_numpy().view(np.uint64)]
                if part == other:
                    others = cell.links(group, *member, percent)
                    u += [key] * len(others)
                    v += others
                if part == home:
                    cell.hold(key, group, *member)
            yield batch_of(u, v)

    size = 8 * F.size("hashes") + BINS + 256
    sized = met.join(sets.select("key", size.cast("long").alias("size")), "key")
    so_far = F.sum("size").over(Window.partitionBy("band").orderBy("key"))
    parts = sized.withColumn("part", F.floor((so_far - F.col("size")) / held).cast("int"))
    parts = parts.withColumn("last", F.max("part").over(Window.partitionBy("band")))
    at = F.explode(F.sequence(F.lit(0), "last")).alias("with")
    cells = parts.select("*", at).withColumns({"home": F.least("part", "with"), "other": F.greatest("part", "with")})
    dealt = cells.join(sets, "key").select(*names).repartition(shuffle_partitions(met.sparkSession), "band", "home", "other")
    return dealt.sortWithinPartitions("band", "home", "other", "part", "key").mapInArrow(run, "u long, v long")


def tree_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v) pairs of classes with equal fingerprints, or with ones that the tree links: about one a class."""
    prints = materialise(classes.groupBy("fp").agg(F.min("cls").alias("rep")), "fingerprints")
    equal = classes.select("cls", "fp").join(prints, "fp").where("cls <> rep").select(F.col("cls").alias("u"), F.col("rep").alias("v"))
    return equal.unionByName(links(prints, radius=radius)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def meetings(classes: DataFrame) -> DataFrame:
    """(band, at, key, sig) of the bands that two classes or more agree in; signatures join these alone."""
    rows = classes.select(F.col("cls").alias("key"), F.posexplode("bands").alias("at", "band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return rows.join(shared, "band", "left_semi").join(classes.select(F.col("cls").alias("key"), "sig"), "key").select("band", "at", "key", "sig")


def shingle_sets(docs: DataFrame, *, text: str, shingle: int, sketch: bool = True) -> DataFrame:
    """(key, hashes, sketch): each document's class, shingle set and its sketch, if that is asked for."""

    def make():
        def of(texts: list[str]) -> list[pa.Array]:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            out = [pa.array(map(class_of, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            return [*out, pa.array(map(sketch_of, sets), pa.binary())] if sketch else out

        return of

    added = [T.StructField("key", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))] + [T.StructField("sketch", T.BinaryType())] * sketch
    return with_columns(docs.select(F.col(text).alias("_t")), "_t", added, make, drop=("_t",))


@dataclass(frozen=True)
class Corpus:
    """The texts and their classes (cls, rep, bands, sig)."""

    docs: DataFrame
    classes: DataFrame
    key: str
    text: str
    shingle: int

    def sets(self, asked: DataFrame) -> DataFrame:
        """``shingle_sets``, one row for each class in ``asked`` (key)."""
        ids = self.classes.join(asked, F.col("cls") == asked["key"], "left_semi").select(F.col("rep").alias("_id")).distinct()
        rows = self.docs.select(F.col(self.key).cast("long").alias("_id"), self.text)
        rows = rows.join(ids, "_id", "left_semi").unionByName(rows.where("_id is null"))
        sets = shingle_sets(rows, text=self.text, shingle=self.shingle).join(asked, "key", "left_semi")
        return materialise(sets.groupBy("key").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch")), "sets")  # all of a class are equal


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose texts' Jaccard similarity reaches ``percent`` / 100."""
    a, b = sets.select(F.col("key").alias("u"), F.col("hashes").alias("hu")), sets.select(F.col("key").alias("v"), F.col("hashes").alias("hv"))
    shared = F.size(F.array_intersect("hu", "hv"))
    alike = (100 + percent) * shared >= percent * (F.size("hu") + F.size("hv"))  # shared / union >= percent / 100
    return materialise(pairs.join(a, "u").join(b, "v").where(alike).select("u", "v"), "linked")


def by_group(met: DataFrame, groups: DataFrame) -> DataFrame:
    """``met`` with each class's group, without the meetings within one group."""
    grouped = met.join(groups.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("group", F.coalesce("component", "key")).drop("component")
    going_on = grouped.groupBy("band").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("band")
    return grouped.join(going_on, "band", "left_semi")


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = 20, rows: int = 4, radius: int = 3) -> DataFrame:
    """(key, component_id): the group of each document, named by its smallest id."""
    known = materialise(marks(docs, key=key, text=text, shingle=shingle, bands=bands, rows=rows), "marks")
    classes = materialise(known.groupBy("cls").agg(F.min("key").alias("rep"), *(F.first(c).alias(c) for c in ("bands", "sig", "fp"))), "classes")
    met, near = materialise(meetings(classes), "meetings"), materialise(tree_pairs(classes, radius), "tree")
    asked = met.select("key").unionByName(near.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    sets = Corpus(docs, classes, key, text, shingle).sets(asked)
    linked = similar(near, sets, percent)
    now = by_group(met, materialise(connected_components(linked), "groups")).join(sets.select("key", "sketch"), "key")
    pairs = materialise(candidates(now, WIDE, 1).groupBy("u").agg(F.min("v").alias("v")), "pairs")
    linked = linked.unionByName(similar(pairs, sets, percent))
    now = by_group(met, materialise(connected_components(linked), "groups"))
    linked = linked.unionByName(materialise(settle(now, sets, WIDE, percent), "settled"))
    groups = materialise(connected_components(linked), "groups")
    named = classes.select("cls", "rep").join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select("cls", F.col("least").alias("rep"))
    return known.select("key", "cls").join(named, "cls").select("key", F.col("rep").alias("component_id"))


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the near copies of an earlier document (by id); null ids stay."""
    return without_later(docs, near_copies(docs, key=key, text=text, **kw), key)
