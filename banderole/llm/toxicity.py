"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 6-grams (with word-end marks) and itself, hashed into
buckets; its vector is the mean of their embeddings, a text's vector the mean over its words, and a
two-class softmax reads that.  Embeddings and softmax are trained jointly in numpy on a sample of
labelled texts, bounded in rows; the texts are read whole.  A misspelling that was never seen shares
most n-grams with the word.  Long runs without white space count as overlapping windows, one word
each, so every n-gram counts.

The sample's texts stay on the executors: tasks count the buckets' texts by class, the driver picks
the buckets that tell the classes apart, and tasks return the bags of those alone.  As the
classifier is linear in the mean, every bucket's embedding collapses to one number for scoring:
workers need one float per bucket and remember words' values.

Edge cases: null and empty texts have no words and get the bias's score; a row without a label or
with a null id is scored all the same; if either class has no training rows, every score is the
smoothed share of the other; repeated rows repeat, and of several texts with one labelled id the
least is trained on; an empty table gives no rows; extra columns pass through ``score``, one with
the score's name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, texts_of, with_columns
from .store import materialise, shuffle_partitions

STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`"
WINDOW = 64  # characters of a long word that count as one word


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and the model's shape."""

    toxic_rows: int = 1200
    clean_rows: int = 2400
    buckets: int = 1 << 16
    dim: int = 8
    epochs: int = 30
    batch: int = 64
    rate: float = 2.0
    momentum: float = 0.9
    least_texts: int = 3  # n-grams in fewer training texts keep no vector: they can only be memorised
    least_z: float = 5.0  # nor do n-grams whose shares in the two classes differ by less than chance explains
    seed: int = 7


def bare(word: str) -> str:
    """The characters whose n-grams count: a word with its end marks, or a window as it is."""
    return word[1:] if word[:1] == " " else "<" + word.strip(STRIP) + ">"


def windows(word: str) -> list[str]:
    """A word, or a long one's overlapping windows, each after a space: together they hold all its n-grams."""
    if len(word) <= WINDOW or len(w := bare(word)) <= WINDOW + 2:
        return [word]
    return [" " + w[k : k + WINDOW] for k in range(0, len(w) - 5, WINDOW - 5)]


def subwords(word: str, buckets: int) -> list[int]:
    w = bare(word)
    grams = {w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)} | {w}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def text_words(text: str) -> list[str]:
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= WINDOW else [x for w in words for x in windows(w)]


@dataclass
class Model:
    """Scores are sigmoid(mean of the words' values + bias)."""

    values: np.ndarray  # per bucket
    bias: float

    def word(self, word: str) -> float:
        return float(self.values[subwords(word, self.values.size)].mean())


def _crc_table() -> np.ndarray:
    """One byte's step of CRC-32 (reflected polynomial 0xEDB88320), as zlib computes it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def word_values(model: Model, words: list[str]) -> np.ndarray:
    """``model.word`` of every word, all at once but for words that repeat a trigram."""
    marked = [bare(w) for w in words]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    first = np.flatnonzero((flat & 0xC0) != 0x80)  # of each character's bytes
    wide = np.diff(np.append(first, flat.size))
    longer = [np.flatnonzero(wide > j) for j in (1, 2, 3)]
    owner = np.repeat(np.arange(size.size), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(first.size)  # characters to the word's end
    buckets, none = np.uint32(model.values.size), np.uint32(0xFFFFFFFF)

    def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return CRC[(state ^ byte) & 0xFF] ^ (state >> 8)

    total, state, again = np.zeros(size.size), np.full(first.size, none), np.zeros(0, dtype=np.int64)
    for n in range(1, 7):
        reach = first.size - (n - 1)  # n-grams that start here don't leave the array
        if reach <= 0:
            break
        state = step(state[:reach], flat[first[n - 1 :]])
        for j, at in enumerate(longer, 1):
            at = at[at >= n - 1]
            if at.size:
                state[at - (n - 1)] = step(state[at - (n - 1)], flat[first[at] + j])
        if n >= 3:
            at = np.flatnonzero(room[:reach] >= n)
            total += np.bincount(owner[at], weights=model.values[(state[at] ^ none) % buckets], minlength=size.size)
        if n == 3:
            trigrams = np.sort((owner[at] << 32) | state[at])
            again = np.unique(trigrams[1:][trigrams[1:] == trigrams[:-1]] >> 32)
    whole = np.flatnonzero((size > 6) | (size < 3))  # others are among their own n-grams
    crcs = np.fromiter((zlib.crc32(marked[i].encode("utf-8", "surrogatepass")) for i in whole.tolist()), dtype=np.uint32, count=whole.size)
    total[whole] += model.values[crcs % buckets]
    grams = sum(np.maximum(size - n + 1, 0) for n in range(3, 7)) + ((size > 6) | (size < 3))
    out = total / grams
    for i in again.tolist():
        out[i] = model.word(words[i])
    return out


class Scorer:
    """Scores texts, remembering words' values."""

    LIMIT = 200_000  # remembered words
    CHUNK = 1 << 17  # words of texts whose new words are valued together

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _chunk(self, bags: list[list[str]]) -> list[float]:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        new = list(set().union(*bags).difference(self.known))
        if new:
            self.known.update(zip(new, word_values(self.model, new).tolist()))
        value = self.known.__getitem__
        return [sum(map(value, words)) / len(words) if words else 0.0 for words in bags]

    def scores(self, texts: list[str]) -> np.ndarray:
        means: list[float] = []
        bags, held = [], 0
        for t in texts:
            bags.append(text_words(t))
            held += len(bags[-1])
            if held > self.CHUNK:
                means += self._chunk(bags)
                bags, held = [], 0
        means += self._chunk(bags)
        return 1 / (1 + np.exp(-np.clip(np.array(means) + self.model.bias, -30, 30)))


class Bags:
    """Mean subword bags of texts, with words' buckets remembered."""

    LIMIT = 100_000

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, weight) of a text; the weights add up to one, or there are none."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        bag: dict[int, float] = {}
        words = text_words(text)
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = subwords(w, self.buckets)
            share = 1 / (len(ids) * len(words))
            for k in ids:
                bag[k] = bag.get(k, 0.0) + share
        return np.fromiter(bag.keys(), dtype=np.int64, count=len(bag)), np.fromiter(bag.values(), dtype=np.float32, count=len(bag))


def telling(texts_with: np.ndarray, of_toxic: np.ndarray, n: int, n1: int, s: Settings) -> np.ndarray:
    """The buckets that enough texts hold and whose shares in the two classes differ."""
    pooled = texts_with / n
    noise = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / (n - n1)))
    z = (of_toxic / n1 - (texts_with - of_toxic) / (n - n1)) / noise
    return np.flatnonzero((texts_with >= s.least_texts) & (np.abs(z) >= s.least_z))


def constant(share: float, s: Settings) -> Model:
    return Model(np.zeros(s.buckets, dtype=np.float32), float(np.log(share / (1 - share))))


def train(texts: list[str], labels: np.ndarray, prior: float, s: Settings = Settings()) -> Model:
    """``fit`` on texts in memory."""
    labels = np.asarray(labels)
    of = Bags(s.buckets)
    bags = [of.of(t) for t in texts]
    some = np.array([c.size > 0 for c, _ in bags], dtype=bool)
    labels = labels[some] if labels.size else labels
    bags = [b for b in bags if b[0].size]
    n, n1 = labels.size, int(labels.sum())
    if not 0 < n1 < n:
        return constant((n1 + 0.5) / (n + 1), s)
    rows = [np.bincount(np.concatenate([c for (c, _), y in zip(bags, labels) if y in ys]), minlength=s.buckets) for ys in ((0, 1), (1,))]
    used = telling(*rows, n, n1, s)
    if not used.size:
        return constant(prior, s)
    kept = [within(b, used) for b in bags]
    return descend(np.cumsum([0, *(c.size for c, _ in kept)]), np.concatenate([c for c, _ in kept]), np.concatenate([w for _, w in kept]), labels, used, rows[0][used], prior, s)


def within(bag: tuple[np.ndarray, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a bag in the sorted buckets ``used``, by its places there."""
    cols, weights = bag
    at = np.searchsorted(used, cols)
    keep = used[np.minimum(at, used.size - 1)] == cols
    return at[keep], weights[keep]


def descend(starts: np.ndarray, cols: np.ndarray, weights: np.ndarray, labels: np.ndarray, used: np.ndarray, texts_with: np.ndarray, prior: float, s: Settings) -> Model:
    """Joint training of embeddings and softmax by plain gradient steps with momentum.

    Every bucket's weights are scaled to one mean square, then all share one step size: n-grams that
    many toxic texts share outgrow those that a single text could memorise.  ``prior`` is the share of label 1 that scores are calibrated to.
    """
    seen = float(labels.mean())
    rng = np.random.default_rng(s.seed)
    level = np.sqrt(np.bincount(cols, weights=weights**2, minlength=used.size) / texts_with)
    weights = (weights / level[cols]).astype(np.float32)
    emb = np.zeros((used.size, s.dim), dtype=np.float32)
    out = rng.standard_normal((s.dim, 2)).astype(np.float32)
    unit = s.rate * labels.size / float((weights**2).sum())  # one over the mean squared length of a text
    bias = np.log(np.array([1 - seen, seen], dtype=np.float32))
    v_emb, v_out, v_bias = np.zeros_like(emb), np.zeros_like(out), np.zeros_like(bias)
    for epoch in range(s.epochs):
        slower = 1 - epoch / s.epochs
        for rows in np.array_split(rng.permutation(labels.size), max(1, labels.size // s.batch)):
            at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            per = np.repeat(np.arange(rows.size), starts[rows + 1] - starts[rows])
            col, wt = cols[at], weights[at]
            hidden = np.stack([np.bincount(per, weights=emb[col, k] * wt, minlength=rows.size) for k in range(s.dim)], axis=1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(rows.size), labels[rows]] -= 1
            p /= rows.size
            d_hidden = p @ out.T
            d_emb = np.stack([np.bincount(col, weights=wt * d_hidden[per, k], minlength=used.size) for k in range(s.dim)], axis=1)
            for value, speed, step, rate in ((out, v_out, hidden.T @ p, 0.05), (bias, v_bias, p.sum(axis=0), 0.05), (emb, v_emb, d_emb, unit)):
                speed *= s.momentum
                speed -= slower * rate * step
                value += speed
    values = np.zeros(s.buckets, dtype=np.float32)
    values[used] = emb @ (out[:, 1] - out[:, 0]) / level
    shift = np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return Model(values, float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> Model:
    """Train on a sample of at most ``toxic_rows + clean_rows`` labelled texts, drawn by id hash.

    ``labels`` must already be free of rows that are held out.  Only ids are drawn first; the
    texts are then found by a broadcast of that bounded list of ids and kept in the shared folder.
    The driver gets one count per bucket, then the bags within the telling buckets.
    """
    rows = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    share = rows.agg(F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    draws = [rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in ((1, s.toxic_rows), (0, s.clean_rows))]
    drawn = draws[0].unionByName(draws[1]).dropDuplicates(["k"]).toPandas()
    if drawn.empty:
        return constant(0.5, s)
    few = docs.sparkSession.createDataFrame(drawn.astype({"k": "int64", "y": "int32"}))
    found = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k")
    one_each = found.groupBy("k").agg(F.min("t").alias("t"), F.max("y").cast("int").alias("y")).repartition(shuffle_partitions(docs.sparkSession), "k")
    sample = materialise(one_each, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, texts = Bags(s.buckets), np.zeros((2, s.buckets), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for b in batches:
            for part in slices(b):
                for t, y in zip(texts_of(part["t"]), part["y"].to_pylist()):
                    cols, _ = of.of(t)
                    seen[y, cols] += 1
                    texts[y] += cols.size > 0
        at = np.flatnonzero(seen.sum(axis=0))
        made = [np.append(at, s.buckets), *(np.append(seen[y, at], texts[y]) for y in (0, 1))]  # the last row counts texts
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["bucket", "n0", "n1"])

    tallies = sample.select("t", "y").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    by = np.zeros((2, s.buckets + 1), dtype=np.int64)
    by[:, tallies["bucket"]] = tallies[["n0", "n1"]].to_numpy().T
    n, n1 = int(by[:, -1].sum()), int(by[1, -1])
    if not 0 < n1 < n:
        return constant((n1 + 0.5) / (n + 1), s)
    texts_with = by[:, :-1].sum(axis=0)
    used = telling(texts_with, by[1, :-1], n, n1, s)
    prior = (float(share["n1"]) + 0.5) / (float(share["n"]) + 1)
    if not used.size:
        return constant(prior, s)
    wanted = docs.sparkSession.sparkContext.broadcast(used)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Bags(s.buckets)
        for b in batches:
            for part in slices(b):
                bags = [of.of(t) for t in texts_of(part["t"])]
                some = pa.array([c.size > 0 for c, _ in bags], pa.bool_())
                made = [within(x, wanted.value) for x in bags if x[0].size]
                lists = [pa.array([x[i] for x in made], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part["k"].filter(some), part["y"].filter(some), *lists], names=["k", "y", "cols", "weights"])

    bags = sample.select("k", "t", "y").mapInArrow(bag, "k long, y int, cols array<int>, weights array<float>").toPandas().sort_values("k")
    wanted.unpersist()
    starts = np.cumsum([0, *map(len, bags["cols"])])
    return descend(starts, np.concatenate(bags["cols"].to_list()).astype(np.int64), np.concatenate(bags["weights"].to_list()), bags["y"].to_numpy(dtype=np.int64), used, texts_with[used], prior, s)


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score in 0..1 added under ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: [pa.array(scorer.scores(texts), pa.float64())]

    return with_columns(docs, text, [T.StructField(column, T.DoubleType())], make)
