"""Token-id shards with a minimal perfect hash index.

A shard is one binary file: raw token ids of consecutive documents, the documents' keys, and an
index that maps a key to its slot by a minimal perfect hash (a cascade of collision-free bitmaps),
with a stored 32-bit fingerprint, id offset and id count per slot.  A lookup costs a few bitmap
probes, whatever the shard holds; a key that the shard doesn't hold fails its fingerprint.

``write_shards`` range-partitions documents by key, so files in (part, seq) order hold ascending
keys; ``read_documents`` fetches every document back by key.

Edge cases: a null text is an empty text (only the end id is stored); null keys sort first;
repeated keys get occurrence numbers 0, 1, ... in a part's files and are separate entries, ordered
by their texts' hash, and one that many rows share is parted by that hash; an empty
table yields no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, texts_of
from .store import materialise, new_path, shuffle_partitions

MAGIC = b"BNDTOK01"
GAMMA = 1.6
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


# --- hashing -----------------------------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key or null, occurrence number)."""
    side = mix64(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + np.uint64(1))
    return mix64(keys.astype(np.int64).view(np.uint64) ^ side)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes; ``slots`` maps members to 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bitmaps, little-endian bits in uint64 words
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        starts = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.ranks = [s + np.concatenate(([0], np.cumsum(c)[:-1])) for s, c in zip(starts, counts)]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest = [], hashes
        while rest.size:
            m = -(-max(64, int(GAMMA * rest.size)) // 64) * 64
            at = cls._at(rest, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
            if len(levels) > 64:
                raise ValueError("the hashes aren't distinct")
        return cls(levels)

    @staticmethod
    def _at(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix64(hashes ^ salt) % np.uint64(m)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots; -1 for what no level holds (a non-member may also get some member's slot)."""
        out = np.full(hashes.size, -1, dtype=np.int64)
        left = np.arange(hashes.size)
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(hashes[left], level, words.size * 64)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            word = words[at >> 6]
            hit = (word & bit) != 0
            below = np.bitwise_count(word & (bit - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return out


# --- the file format ---------------------------------------------------------------------------
def pack_shard(keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray, counts: np.ndarray, payload: bytes, width: int) -> bytes:
    """Bytes of one shard: magic, payload, sections, JSON directory, its length."""
    hashes = key_hash(keys, occurrence, null)
    mph = PerfectHash.build(hashes)
    slot = mph.slots(hashes)
    offsets = np.concatenate(([0], np.cumsum(counts)[:-1])) if counts.size else counts
    table = np.zeros(keys.size, dtype=[("print", "<u4"), ("count", "<u4"), ("offset", "<u8")])
    table["print"][slot], table["count"][slot], table["offset"][slot] = hashes >> np.uint64(32), counts, offsets
    out, places, at = [MAGIC, payload], {"payload": [8, len(payload)]}, 8 + len(payload)
    sections = {"keys": keys.astype("<i8"), "null": null.astype("u1"), "occurrence": occurrence.astype("<u4"), "table": table}
    for name, a in (*sections.items(), *((f"level{i}", w) for i, w in enumerate(mph.levels))):
        out.append(a.tobytes())
        places[name] = [at, len(out[-1])]
        at += len(out[-1])
    head = json.dumps({"width": width, "levels": len(mph.levels), "docs": int(keys.size), "places": places}).encode()
    return b"".join([*out, head, struct.pack("<I", len(head))])


class Shard:
    """Keyed access to one shard's bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", raw[-4:])
        head = json.loads(raw[-4 - n : -4])
        self.raw, self.places, self.docs = raw, head["places"], head["docs"]
        self.ids = self._read("payload", f"<u{head['width']}")
        self.table = self._read("table", np.dtype([("print", "<u4"), ("count", "<u4"), ("offset", "<u8")]))
        self.mph = PerfectHash([self._read(f"level{i}", "<u8") for i in range(head["levels"])])

    def _read(self, name: str, dtype) -> np.ndarray:
        at, n = self.places[name]
        return np.frombuffer(self.raw, dtype=dtype, count=n // np.dtype(dtype).itemsize, offset=at)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stored (keys, occurrence numbers, null flags) in file order."""
        return self._read("keys", "<i8"), self._read("occurrence", "<u4"), self._read("null", "u1")

    def locate(self, keys, occurrence=None, null=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, count) for each key, in constant time each."""
        keys = np.asarray(keys, dtype=np.int64)
        occurrence = np.zeros(keys.size, dtype=np.uint32) if occurrence is None else occurrence
        null = np.zeros(keys.size, dtype=np.uint8) if null is None else null
        hashes = key_hash(keys, occurrence, null)
        slot = self.mph.slots(hashes)
        found = slot >= 0
        if not self.docs:
            return found, np.zeros(keys.size, dtype=np.int64), np.zeros(keys.size, dtype=np.int64)
        rows = self.table[np.where(found, slot, 0)]
        found &= rows["print"] == (hashes >> np.uint64(32)).astype(np.uint32)
        return found, rows["offset"].astype(np.int64), rows["count"].astype(np.int64)

    def get(self, key: int, occurrence: int = 0) -> np.ndarray | None:
        """Token ids of one document, or None."""
        found, at, n = self.locate([key], np.array([occurrence], dtype=np.uint32))
        return self.ids[at[0] : at[0] + n[0]] if found[0] else None


# --- encoding ----------------------------------------------------------------------------------
class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, remembering word encodings.

    Its pre-tokens never span a break before white space, but for runs of three or more and runs
    at the end of a text or before an added token, so any other text may be cut before each space
    and line end and encoded piecewise.  New pieces without white space inside are encoded together,
    a vertical tab between them; texts with such runs go to the library whole.  Probes hold this against the library; a
    tokenizer that cuts otherwise gets all texts whole.
    """

    LIMIT, TOGETHER, HELD = 500_000, 512, 1 << 20
    SEPARATOR, MARKS = "\x0b", ".,;:!?)"
    RUNS = re.compile(r"\s\s(?:\s|\Z)")
    PROBES = ("It's a  test\nof\n\nwords, 12 x3 <|endoftext|> and\t\ttabs", " \nx", "a \nb\u00e9\u3000 c", "don't\nwe'll 100% [ok] ", "")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str | tuple[str], bytes] = {}  # pieces by themselves, a text's first one as a tuple
        self.older: dict[str | tuple[str], bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        (mark,) = self._ids([self.SEPARATOR])
        self.mark = int.from_bytes(mark, "little") if len(mark) == self.width else None
        self.cuts = self.mark is not None
        self.cuts = self.cuts and self.encode(list(self.PROBES), None) == list(self._ids(list(self.PROBES)))

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        code = "H" if self.width == 2 else "I"
        for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            yield array(code, e.ids).tobytes()

    def _together(self, pieces: list[str]) -> Iterator[bytes]:
        """``_ids`` of pieces without white space inside, some thousand in one call."""
        for k in range(0, len(pieces), self.TOGETHER):
            some = pieces[k : k + self.TOGETHER]
            (raw,) = self._ids([self.SEPARATOR.join(some)])
            ids = np.frombuffer(raw, dtype=f"<u{self.width}")
            ends = np.append(np.flatnonzero(ids == self.mark), ids.size)
            if ends.size != len(some):
                yield from self._ids(some)
                continue
            begins = np.append(0, ends[:-1] + 1)
            for a, b in zip((begins * self.width).tolist(), (ends * self.width).tolist()):
                yield raw[a:b]

    @staticmethod
    def _clean(piece: str | tuple[str]) -> bool:
        """Whether a piece has no white space but the one that it starts with."""
        bare = piece[0] if isinstance(piece, tuple) else piece[1:] if piece[:1] == "\n" else piece
        return bare.split() == [bare] or piece == ("",)

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        tail = b"" if end is None else int(end).to_bytes(self.width, "little")
        if not self.cuts:
            return [ids + tail for k in range(0, len(texts), 64) for ids in self._ids(texts[k : k + 64])]
        out: list[bytes] = []
        rows: list[list[bytes] | str] = []  # a text's pieces, or a text to encode whole
        asked: dict[str | tuple[str], list[tuple[list[bytes], int]]] = {}  # unknown pieces and where they stand
        odd: dict[str | tuple[str], list[tuple[list[bytes], int]]] = {}  # never remembered: a text with one is looked at for runs
        held = 0

        def settle() -> None:
            nonlocal held
            for c, raw in zip(list(asked), self._together([self._written(c) for c in asked])):
                self.known[c] = raw
                for row, i in asked[c]:
                    row[i] = raw
            for places, raw in zip(odd.values(), self._ids([self._written(c) for c in odd])):
                for row, i in places:
                    row[i] = raw
            of_whole = self._ids([r for r in rows if isinstance(r, str)])
            out.extend((next(of_whole) if isinstance(r, str) else b"".join(r)) + tail for r in rows)
            rows.clear()
            asked.clear()
            odd.clear()
            held = 0

        for t in texts:
            if len(self.known) > self.LIMIT:
                self.known, self.older = {}, self.known
            cut: list = t.replace("\n", " \n").split(" ")
            cut[0] = (cut[0],)
            row: list = list(map(self.known.get, cut))
            doubtful = False
            for i in [i for i, raw in enumerate(row) if raw is None]:
                c = cut[i]
                if (raw := self.known.get(c)) is not None:  # new when it stood in this text before
                    row[i] = raw
                elif (places := asked.get(c)) is not None:
                    places.append((row, i))
                elif (raw := self.older.get(c)) is not None or (raw := self._from_base(c)) is not None:
                    row[i] = self.known[c] = raw
                elif self._clean(c):
                    asked[c] = [(row, i)]
                else:
                    doubtful = True
                    odd.setdefault(c, []).append((row, i))
            if doubtful and (self.RUNS.search(t) or any(x in t for x in self.added)):
                rows.append(t)
                held += len(t)
            else:
                rows.append(row)
                held += len(row)
            if held > self.HELD:
                settle()
        settle()
        return out

    def _from_base(self, piece: str | tuple[str]) -> bytes | None:
        """A known word of letters and the marks after it, which are pre-tokens of their own."""
        if isinstance(piece, tuple):
            return None
        base = piece.rstrip(self.MARKS)
        if len(base) == len(piece) or not base.isalpha() or (raw := self.known.get(base) or self.older.get(base)) is None:
            return None
        marks = piece[len(base) :]
        if marks not in self.marks:
            (self.marks[marks],) = self._ids([marks])
        return raw + self.marks[marks]

    @staticmethod
    def _written(piece: str | tuple[str]) -> str:
        return piece[0] if isinstance(piece, tuple) else piece if piece[:1] == "\n" else " " + piece


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Write whole or not at all: a retried task replaces the file."""
    files, at = _open(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, at)


def write_shards(docs: DataFrame, out: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int | None = 0, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode ``docs`` into shard files under ``out``; returns the manifest, one row per file.

    Files hold ascending keys by (part, seq).  ``shard_bytes`` bounds a file's payload (one longer
    document makes a longer file), so a task holds one shard at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "k", "h").sortWithinPartitions("k", "h", "t")  # the hash parts a key that many rows share

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        keys, null, occ, counts, parts, size, seq = [], [], [], [], [], 0, 0
        last, times = object(), 0

        def flush() -> pa.RecordBatch:
            path = f"{out}/part-{part:06d}-{seq:05d}.tok"
            n = np.array(counts, dtype=np.int64)
            _put(path, pack_shard(np.array(keys, dtype=np.int64), np.array(null, dtype=np.uint8), np.array(occ, dtype=np.uint32), n, b"".join(parts), enc.width))
            made = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([n.size], pa.int64()), pa.array([int(n.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in MANIFEST.split(", ")])

        for b in batches:
            for some in slices(b):
                for k, ids in zip(some["k"].to_pylist(), enc.encode(texts_of(some["t"]), end)):
                    times = times + 1 if k == last else 0
                    last = k
                    if parts and size + len(ids) > shard_bytes:
                        yield flush()
                        keys, null, occ, counts, parts, size, seq = [], [], [], [], [], 0, seq + 1
                    keys.append(k or 0)
                    null.append(k is None)
                    occ.append(times)
                    counts.append(len(ids) // enc.width)
                    parts.append(ids)
                    size += len(ids)
        if parts:
            yield flush()

    return materialise(rows.mapInArrow(encode, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Fetch every document back by key: key, start (ids before it), n_tokens, ids_crc32.

    ``start`` counts over all files in order; only one row per file goes through that sum.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                source, at = _open(path)
                with source.open_input_stream(at) as f:
                    shard = Shard(f.read())
                keys, occ, null = shard.keys()
                found, offset, count = shard.locate(keys, occ, null)
                if not found.all():
                    raise ValueError(f"{path}: the index misses stored keys")
                crc = [zlib.crc32(shard.ids[o : o + n].astype("<u4")) for o, n in zip(offset, count)]
                made = [pa.array(keys, mask=null == 1), pa.array(base + offset), pa.array(count), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["key", "start", "n_tokens", "ids_crc32"])

    n = shuffle_partitions(manifest.sparkSession)
    return files.repartition(n).mapInArrow(fetch, "key long, start long, n_tokens long, ids_crc32 long")


def tokenise_and_index(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read every document back by key."""
    return read_documents(write_shards(docs, new_path(docs.sparkSession, "token-shards"), tokenizer, **kw))
