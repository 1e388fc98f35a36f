"""SentencePiece encoding and decoding by suffix-array matching.

For a batch, the distinct chunks of text (white-space-led words) that aren't remembered yet are
concatenated; a suffix array over them, sorted to the longest piece's length, is searched for every
piece of the vocabulary at once by binary search.  Each piece's range holds its occurrences; these
edges, sorted by position, are relaxed left to right.

The model is a BPE one, so relaxing doesn't add up scores: the last token of every prefix's encoding
is unique, and an edge is taken if the token before it and its own are what merging would leave next
to each other.  That gives the library's ids exactly.  Characters outside the vocabulary become
their UTF-8 byte pieces.

Edge cases: null and empty texts have no ids and decode to the empty text; a literal U+2581 decodes
to a space, as the library's does; null ids and repeated rows are encoded one by one; an empty table
gives no rows; extra columns pass through ``encode`` and ``decode``, one with the new column's name
is replaced.  A model that this method doesn't reproduce (unigram, a normaliser other than identity,
pieces with a mark inside) raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import kept_fields, lists, quoted, slices, with_columns

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A SentencePiece BPE vocabulary: merge ranks, how pieces come about, bytes to decode."""

    MOST_FITS, MOST_PAIRS = 50_000, 1_000_000  # remembered pairs of pieces; forgotten ones are worked out anew

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.size = n
        self.rank = {text[i]: -sp.get_score(i) for i in plain}
        self.id = {text[i]: i for i in plain}
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.decoded = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.parts: dict[str, tuple[str, str]] = {}
        ok = []
        for i in plain:
            p = text[i]
            if len(p) == 1:
                ok.append(p)
            elif (last := self._last_merge(p)) is not None:
                self.parts[p] = last
                ok.append(p)
        self.pieces = sorted(ok)  # those that merging their own characters leads to
        self.longest = max(map(len, ok))
        lengths = np.array([len(p) for p in self.pieces])
        self.lengths = lengths
        self.ids = np.array([self.id[p] for p in self.pieces])
        self.pair_keys, self.pair_fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.chars = np.zeros((len(self.pieces), self.longest), dtype=np.int32)
        for k, p in enumerate(self.pieces):
            self.chars[k, : len(p)] = [ord(c) for c in p]
        self.fits: dict[tuple[str, str], bool] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts, pair = list(piece), None
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            r, k = min(ranked)
            if r == np.inf:
                return None
            pair = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return pair

    def fit(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` and ``b`` apart when both stand next to each other.

        Undo the later of the two tokens' last merges until something merges across the border
        before what was undone would have happened (they don't fit), or nothing is left to undo.
        """
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= self.MOST_FITS:
                self.fits.clear()
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fit`` for arrays of piece numbers; each distinct pair is worked out once per worker."""
        keys = a.astype(np.int64) * len(self.pieces) + b
        asked, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, asked)
        known = at < self.pair_keys.size
        known[known] = self.pair_keys[at[known]] == asked[known]
        fits = np.zeros(asked.size, dtype=bool)
        fits[known] = self.pair_fits[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            n = len(self.pieces)
            fits[new] = [self._fit(self.pieces[k // n], self.pieces[k % n]) for k in asked[new].tolist()]
            if self.pair_keys.size > self.MOST_PAIRS:
                self.pair_keys, self.pair_fits, at = self.pair_keys[:0], self.pair_fits[:0], at * 0
            self.pair_keys = np.insert(self.pair_keys, at[new], asked[new])
            self.pair_fits = np.insert(self.pair_fits, at[new], fits[new])
        return fits[back]

    def _fit(self, a: str, b: str) -> bool:
        rank, parts = self.rank, self.parts
        limit, on_right = np.inf, False
        while True:
            r = rank.get(a + b, np.inf)
            if r < limit or r == limit < np.inf and on_right:
                return False
            ra = rank[a] if a in parts else -np.inf
            rb = rank[b] if b in parts else -np.inf
            if ra == rb == -np.inf:
                return True
            if ra > rb:
                limit, on_right, a = ra, False, parts[a][1]
            else:
                limit, on_right, b = rb, True, parts[b][0]

    def of_unknown(self, char: str) -> list[int]:
        return [self.byte_id[x] for x in char.encode("utf-8", "surrogatepass")]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` codes at least (prefix doubling)."""
    _, rank = np.unique(codes, return_inverse=True)
    k = 1
    while k < depth:
        after = np.concatenate((rank[k:] + 1, np.zeros(min(k, rank.size), dtype=rank.dtype)))[: rank.size]
        _, rank = np.unique(rank.astype(np.int64) * (rank.max() + 2) + after, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, order: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) ranges of the suffix array that start with each piece: all searched in step."""
    width = chars.shape[1]
    padded = np.concatenate((codes, np.zeros(width, dtype=codes.dtype)))
    inside = np.arange(width)[None, :] < lengths[:, None]

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), order.size, dtype=np.int64)
        live = np.flatnonzero(lo < hi)
        while live.size:
            mid = (lo[live] + hi[live]) // 2
            there = padded[order[mid][:, None] + np.arange(width)[None, :]]
            differ = (there != chars[live]) & inside[live]
            at = differ.argmax(axis=1)
            row = np.arange(live.size)
            sign = np.where(differ[row, at], np.sign(there[row, at] - chars[live, at]), 0)
            right = sign < 0 if not after else sign <= 0
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo

    return bound(False), bound(True)


class Encoder:
    """Encodes texts chunk by chunk, remembering short chunks."""

    LIMIT, SHORT, BATCH, HELD = 400_000, 48, 1 << 19, 1 << 20

    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self.width = 2 if self.pieces.size <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before, so that frequent chunks survive
        self._check(model_file)

    def _check(self, model_file: str) -> None:
        """Hold ids against the library's on probes that other kinds of models encode otherwise."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        p = self.pieces.pieces
        probes = ["a", "ab ba", " a", "a ", "a  b", "\n\t", "\ufb01\u2460\uff21e\u0301", "\U0001f389", "x" * 99]
        probes += ["".join(p[k::97][:60]).replace(MARK, " ") for k in range(97)]
        if any(MARK in x.lstrip(MARK) for x in self.pieces.id) or [np.frombuffer(x, dtype=f"<u{self.width}").tolist() for x in self.encode(probes)] != [sp.encode(x) for x in probes]:
            raise ValueError(f"{model_file}: only BPE models with an identity normaliser and no pieces across words")
        self.known = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids' bytes of each text.  Texts wait as rows of shared bytes until their unknown
        chunks are enough for a match, or the rows are."""
        out: list[bytes] = []
        rows: list[list[bytes]] = []
        asked: dict[str, list[tuple[list[bytes], int]]] = {}  # unknown chunks and where they stand
        size = held = 0

        def settle() -> None:
            nonlocal size, held
            for c, raw in self._match(list(asked)) if asked else ():
                for row, i in asked[c]:
                    row[i] = raw
                if len(c) <= self.SHORT:
                    self.known[c] = raw
            out.extend(map(b"".join, rows))
            rows.clear()
            asked.clear()
            size = held = 0

        for t in texts:
            if len(self.known) > self.LIMIT:
                self.known, self.older = {}, self.known
            cut = self.chunks(t)
            row = list(map(self.known.get, cut))
            rows.append(row)
            if None in row:
                for i, c in enumerate(cut):
                    if row[i] is None:
                        if (raw := self.older.get(c)) is not None:
                            row[i] = self.known[c] = raw
                        elif (places := asked.get(c)) is not None:
                            places.append((row, i))
                        else:
                            asked[c] = [(row, i)]
                            size += len(c) + 1
            held += len(row)
            if size > self.BATCH or held > self.HELD:
                settle()
        settle()
        return out

    def _match(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        p = self.pieces
        joined = "\0".join(chunks) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<i4")
        order = suffix_array(codes, p.longest)
        lo, hi = occurrences(codes, order, p.chars, p.lengths)
        count = hi - lo
        piece = np.repeat(np.arange(len(lo), dtype=np.int32), count)
        place = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        by = np.argsort(place, kind="stable")
        piece, place = piece[by], place[by]
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        base = np.cumsum(lengths + 1) - lengths - 1
        known_char = np.zeros(codes.size, dtype=bool)
        known_char[place[p.lengths[piece] == 1]] = True
        unknown = np.add.reduceat(~known_char, base) > 1  # each chunk's separator is one
        plain = (lengths <= self.SHORT) & ~unknown
        yield from self._relax_all([chunks[k] for k in np.flatnonzero(plain)], base[plain], lengths[plain], codes.size, place, piece)
        if not plain.all():
            edges = np.searchsorted(place, np.arange(codes.size + 1))
            for k in np.flatnonzero(~plain).tolist():
                a, b = base[k], base[k] + lengths[k] + 1
                own = (edges[a:b] - edges[a]).tolist()
                yield chunks[k], self._relax(chunks[k], 0, own, piece[edges[a] : edges[b - 1]].tolist())

    def _relax_all(self, chunks: list[str], base: np.ndarray, lengths: np.ndarray, size: int, place: np.ndarray, piece: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """Relax the edges of many chunks in step: all that start at a chunk's first character, then
        all at its second, and so on; then walk back from all ends in step."""
        if not chunks:
            return
        p = self.pieces
        start = np.full(size, -1)
        start[np.repeat(base, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.repeat(base, lengths)
        mine = start[place] >= 0
        place, piece = place[mine], piece[mine]
        step = place - start[place]
        by = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[by], np.arange(int(lengths.max()) + 1))
        last = np.full(size + 1, -1, dtype=np.int64)
        for k in range(int(lengths.max())):
            at = by[cuts[k] : cuts[k + 1]]
            s, token = place[at], piece[at]
            if k:
                before = last[s]
                live = before >= 0
                s, token, before = s[live], token[live], before[live]
                ok = p.fit_all(before, token)
                s, token = s[ok], token[ok]
            last[s + p.lengths[token]] = token
        ends, rows, tokens = base + lengths, [], []
        live = np.arange(len(chunks))
        while live.size:
            token = last[ends[live]]
            rows.append(live)
            tokens.append(token)
            ends[live] -= p.lengths[token]
            live = live[ends[live] > base[live]]
        row, token = np.concatenate(rows[::-1]), np.concatenate(tokens[::-1])
        by = np.argsort(row, kind="stable")
        raw = p.ids[token[by]].astype(f"<u{self.width}").tobytes()
        stops = (np.cumsum(np.bincount(row, minlength=len(chunks))) * self.width).tolist()
        begin = 0
        for c, stop in zip(chunks, stops):
            yield c, raw[begin:stop]
            begin = stop

    def _relax(self, chunk: str, base: int, edges: list[int], piece: list[int]) -> bytes:
        pieces, fit, n = self.pieces.pieces, self.pieces.fit, len(chunk)
        last: list[str | None] = [None] * (n + 1)
        for s in range(n):
            before = last[s] if s else None
            if s and before is None:
                continue
            free = before is None or before not in self.pieces.id
            for k in range(edges[base + s], edges[base + s + 1]):
                token = pieces[piece[k]]
                e = s + len(token)
                if last[e] is None and (free or fit(before, token)):
                    last[e] = token
            if chunk[s] not in self.pieces.id:
                last[s + 1] = chunk[s]  # an unknown character merges with nothing
        out, e = [], n
        while e:
            token = last[e]
            i = self.pieces.id.get(token)
            out.append([i] if i is not None else self.pieces.of_unknown(token))
            e -= len(token)
        return np.array([i for ids in reversed(out) for i in ids], dtype=f"<u{self.width}").tobytes()

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.pieces.decoded.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder for each Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def encode(docs: DataFrame, model_file: str, *, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` added as an array of ints."""

    def make():
        enc = encoder(model_file)
        return lambda texts: [lists(enc.encode(texts), enc.width)]

    return with_columns(docs, text, [_field(column, T.ArrayType(T.IntegerType()))], make)


def decode(encoded: DataFrame, model_file: str, *, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added."""
    kept = kept_fields(encoded, [column])
    at = [f.name for f in kept].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            for part in slices(b):
                made = pa.array([enc.decode(x or []) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, column])

    return encoded.select(*(F.col(quoted(f.name)) for f in kept)).mapInArrow(run, T.StructType([*kept, _field(column, T.StringType())]))


def digest(docs: DataFrame, model_file: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, id count, crc32 of the ids (unsigned 32-bit), the decoded text's sha256,
    and whether decoding gives the text again (but for U+2581)."""

    def make():
        enc = encoder(model_file)

        def of(texts: list[str]) -> list[pa.Array]:
            n, crc, sha, same = [], [], [], []
            for t, raw in zip(texts, enc.encode(texts)):
                ids = np.frombuffer(raw, dtype=f"<u{enc.width}")
                back = enc.decode(ids.tolist())
                n.append(ids.size)
                crc.append(zlib.crc32(ids.astype("<u4")))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t.replace(MARK, " "))
            return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]

        return of

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t"))
    added = [_field("n_ids", T.LongType()), _field("ids_crc32", T.LongType()), _field("decoded_sha256", T.StringType()), _field("round_trip", T.BooleanType())]
    return with_columns(rows, "_t", added, make, drop=("_t",))
