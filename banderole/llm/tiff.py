"""Media columns: TIFF files in a binary column.

``tiff_pages`` walks the image directories of each file, decodes PackBits, LZW or deflate strips
and tiles, undoes horizontal predictors and gives one row per page.  ``encode_tiff`` writes
8-bit multi-page files with any of those layouts; ``store_payloads`` keeps arbitrary byte payloads
as RGB samples and reads them back.

Edge cases: a null text is an empty text (its payload is one row of spaces); a null file gives no
page rows; a damaged file gives the pages before the damage and a row with its ``error`` set instead
of failing the job, whatever sides it claims; equal payloads give equal files; null ids and repeated
rows are handled one by one; an empty table gives no rows; extra columns are dropped from results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, with_columns
from .store import materialise

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS


# --- compression codecs ------------------------------------------------------------------------
def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, the rest literals of up to 128."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not a.size:
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lengths = np.diff(np.append(starts, a.size))
    out, literal = bytearray(), 0

    def literals(upto: int) -> None:
        nonlocal literal
        while literal < upto:
            n = min(128, upto - literal)
            out.append(n - 1)
            out.extend(data[literal : literal + n])
            literal += n

    for at, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
        literals(at)
        for k in range(0, n, 128):
            m = min(128, n - k)
            if m == 1:
                out += bytes((0, data[at]))
            else:
                out += bytes((257 - m, data[at]))
        literal = at + n
    literals(a.size)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF flavour: most significant bit first, codes widen one early, 256 clears, 257 ends."""
    codes, clears = [256], [0]
    table, following, w = {}, 258, -1  # (code << 8 | byte) to the code of both
    for c in data:
        if w < 0:
            w = c
            continue
        pair = w << 8 | c
        code = table.get(pair)
        if code is not None:
            w = code
            continue
        codes.append(w)
        table[pair] = following
        following += 1
        if following == 4095:
            clears.append(len(codes))
            codes.append(256)
            table, following = {}, 258
        w = c
    if w >= 0:
        codes.append(w)
    codes.append(257)
    # The k-th code after a clear code is written when the table holds 257 + k entries.
    since = np.arange(len(codes)) - np.repeat(clears, np.diff([*clears, len(codes)]))
    since[clears[1:]] = np.diff(clears)  # a clear code still belongs to the table that it clears
    widths = np.where(since + 257 >= 2048, 12, np.where(since + 257 >= 1024, 11, np.where(since + 257 >= 512, 10, 9)))
    bits = (np.array(codes)[:, None] >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits[np.arange(12) >= (12 - widths)[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, b""
    out, bits, held = [], 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise ValueError("bad LZW code")
        out.append(entry)
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 3), PACKBITS: packbits_encode}
DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, PACKBITS: packbits_decode, 32946: zlib.decompress}


# --- the file format ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Layout:
    """How a page is stored: codec, horizontal predictor, and tile height (0: strips)."""

    codec: int = DEFLATE
    predictor: bool = False
    tile: int = 0
    strip_rows: int = 256


def encode_tiff(pages: list[np.ndarray], layout: Layout) -> bytes:
    """A little-endian TIFF of (rows, width, channels) uint8 pages."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        rows, width, channels = page.shape
        step = layout.tile or layout.strip_rows
        offsets, sizes = [], []
        for top in range(0, rows, step):
            part = page[top : top + step]
            if layout.tile and part.shape[0] < step:
                part = np.concatenate((part, np.zeros((step - part.shape[0], width, channels), dtype=np.uint8)))
            if layout.predictor:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)
            body = ENCODERS[layout.codec](part.tobytes())
            offsets.append(len(out))
            sizes.append(len(body))
            out += body + b"\0" * (len(body) & 1)
        tags = {256: (4, [width]), 257: (4, [rows]), 258: (3, [8] * channels), 259: (3, [layout.codec]), 262: (3, [2 if channels == 3 else 1]), 277: (3, [channels]), 284: (3, [1]), 317: (3, [2 if layout.predictor else 1])}
        if layout.tile:
            tags |= {322: (4, [width]), 323: (4, [step]), 324: (4, offsets), 325: (4, sizes)}
        else:
            tags |= {273: (4, offsets), 278: (4, [step]), 279: (4, sizes)}
        entries = bytearray()
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                place = struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) & 1)
            else:
                place = body.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    """One decoded directory."""

    index: int
    width: int
    height: int
    channels: int
    codec: int
    tiled: bool
    predictor: int
    samples: np.ndarray = field(repr=False)


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(f"{order}H", raw, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        size = TYPE_SIZES.get(kind, 1) * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", raw, place)
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw, place))
    (following,) = struct.unpack_from(f"{order}I", raw, at + 2 + 12 * n)
    return tags, following


def walk_tiff(raw: bytes) -> Iterator[Page]:
    """Pages in directory order; raises ValueError on what isn't a chunky 8-bit TIFF."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if not order:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    index, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, following = _directory(raw, at, order)
        one = lambda tag, default: tags.get(tag, [default])[0]
        width, height, channels = one(256, 0), one(257, 0), one(277, 1)
        codec, predictor, tiled = one(259, 1), one(317, 1), 324 in tags
        if set(tags.get(258, [1])) != {8} or one(284, 1) != 1 or codec not in DECODERS or predictor not in (1, 2):
            raise ValueError("unsupported samples, codec or predictor")
        rows, cols = (one(323, height), one(322, width)) if tiled else (min(one(278, height), height), width)
        if min(width, height, channels, rows, cols) < 1:
            raise ValueError("a side is zero")
        across, down = -(-width // cols), -(-height // rows)
        places, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
        if len(places) != across * down or len(sizes) != len(places):
            raise ValueError("the strips or tiles don't cover the page")
        blocks = [np.frombuffer(DECODERS[codec](raw[place : place + size]), dtype=np.uint8) for place, size in zip(places, sizes)]
        if sum(x.size for x in blocks) < height * width * channels:  # before room for the claimed sides is taken
            raise ValueError("fewer samples than the page claims")
        samples = np.zeros((height, width, channels), dtype=np.uint8)
        for k, block in enumerate(blocks):
            top, left = k // across * rows, k % across * cols
            block = block.reshape(-1, cols, channels)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            part = samples[top : top + rows, left : left + cols]
            part[...] = block[: part.shape[0], : part.shape[1]]
        yield Page(index, width, height, channels, codec, tiled, predictor, samples)
        index, at = index + 1, following


PAGES = "key long, page int, width int, height int, channels int, codec int, tiled boolean, samples binary, error string"
PAGE_KINDS = [pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.binary(), pa.string()]
DAMAGE = (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError)


def tiff_pages(files: DataFrame, *, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per page of each file, with decoded samples."""

    def rows_of(k: int | None, raw: bytes) -> Iterator[tuple]:
        try:
            for p in walk_tiff(raw):
                yield k, p.index, p.width, p.height, p.channels, p.codec, p.tiled, p.samples.tobytes(), None
        except DAMAGE as e:
            yield k, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b["k"].to_pylist(), b["m"]):
                for row in rows_of(k, raw.as_py()) if raw.is_valid else ():
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, PAGE_KINDS)], names=[c.split()[0] for c in PAGES.split(", ")])

    return files.select(F.col(key).cast("long").alias("k"), F.col(media).alias("m")).mapInArrow(pages, PAGES)


# --- payloads as pictures ----------------------------------------------------------------------
PAGE_ROWS = 4096
LAYOUTS = (
    Layout(PACKBITS),
    Layout(LZW, predictor=True),
    Layout(DEFLATE, tile=16),
    Layout(DEFLATE, predictor=True),
    Layout(PACKBITS, tile=256),
    Layout(LZW, tile=64),
    Layout(DEFLATE),
    Layout(DEFLATE, strip_rows=64),
)


def layout_for(payload: bytes) -> Layout:
    """A layout chosen by the payload's checksum, whatever its size."""
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of a row, and their unpadded count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" "), len(raw)


def payload_to_tiff(payload: bytes) -> bytes:
    picture = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, CHANNELS)
    return encode_tiff([picture[k : k + PAGE_ROWS] for k in range(0, len(picture), PAGE_ROWS)], layout_for(payload))


def feature_of(samples: np.ndarray, pages: int) -> str:
    """Pages, rows, channel means in 1/256, and a 16-bin histogram of the decoded samples."""
    flat = samples.reshape(-1)
    bins = np.bincount(flat >> 4, minlength=16)
    sums = samples.reshape(-1, CHANNELS).sum(axis=0, dtype=np.int64) * 256 // max(1, flat.size // CHANNELS)
    return f"{pages}p{samples.shape[0]}r|" + ",".join(map(str, sums.tolist())) + "|" + ",".join(map(str, bins.tolist()))


def encode_payloads(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: every whole text as a TIFF."""

    def make():
        def of(texts: list[str]) -> list[pa.Array]:
            made = [payload_of(t) for t in texts]
            return [pa.array([n for _, n in made], pa.int64()), pa.array([payload_to_tiff(p) for p, _ in made], pa.binary())]

        return of

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t"))
    return with_columns(rows, "_t", [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], make, drop=("_t",))


DIGESTS = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_digests(media: DataFrame) -> DataFrame:
    """Walk each stored file's pages and digest the payload that they hold together."""

    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                rows = []
                for raw in (x.as_py() for x in part["media"]):
                    pages = [p.samples for p in walk_tiff(raw)]
                    samples = np.concatenate(pages)
                    data = samples.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(samples, len(pages))))
                yield pa.RecordBatch.from_arrays([part["key"], part["n_bytes"], *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)

    return media.select("key", "n_bytes", "media").mapInArrow(digest, DIGESTS)


def store_payloads(docs: DataFrame, **kw) -> DataFrame:
    """Encode every text, write the media table to the shared folder, read it back and digest it."""
    return payload_digests(materialise(encode_payloads(docs, **kw), "media"))
