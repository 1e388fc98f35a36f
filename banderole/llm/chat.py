"""Chat formatting by columnar byte assembly.

Turns become ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash is put
before the bar of every ``<|`` (and of every already escaped one), so control strings can't be
forged and unescaping restores the text exactly.

Formatting never goes row by row: for a batch, numpy computes segment lengths, cumulative offsets
and scatter indices, and copies headers and contents into one preallocated Arrow buffer.

A conversation may hold any share of all turns: rows are range-partitioned by (conversation, turn),
so a long one is formatted by many tasks as consecutive chunks.  They stay rows: digests stream over
them in order, and no cell or list ever holds a whole conversation.  A SHA-256 over a whole
conversation is a chain, so one task passes over its chunks, one chunk in memory at a time.

Edge cases: null roles and texts are empty; null turns come first, turns with equal numbers go by
role, then text; a null conversation id is a conversation of its own; no rows give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import short_keys
from .store import shuffle_partitions

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
CLOSE = f"{END}\n".encode()

_TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(column: pa.Array) -> pa.Array:
    """Put one more backslash into every ``<``, backslashes, ``|`` (and, for roles, no line ends)."""
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def escape_role(column: pa.Array) -> pa.Array:
    """Roles end at the first line end, so theirs are written as a marked escape."""
    return escape(pc.replace_substring_regex(pc.replace_substring(column, "\\", "\\\\"), pattern="\n", replacement=r"\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, data) of a string array without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return offsets[:-1], np.diff(offsets), data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """(end offset of each formatted turn, one buffer with all of them)."""
    headers = pc.binary_join_element_wise(pa.scalar(START), escape_role(roles), pa.scalar("\n"), "")
    (hs, hl, hd), (ts, tl, td) = _bytes(headers), _bytes(escape(texts))
    close = np.frombuffer(CLOSE, dtype=np.uint8)
    ends = np.cumsum(hl + tl + close.size)
    begins = ends - (hl + tl + close.size)
    buffer = pa.allocate_buffer(int(ends[-1]) if ends.size else 0)
    out = np.frombuffer(buffer, dtype=np.uint8)

    def scatter(at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
        total = int(lengths.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(at, lengths) + within] = data[np.repeat(starts, lengths) + within]

    out.flags.writeable or out.setflags(write=True)
    scatter(begins, hs, hl, hd)
    scatter(begins + hl, ts, tl, td)
    for k in range(close.size):
        out[ends - close.size + k] = close[k]
    return ends, buffer


CHUNKS = "conv_id long, part int, chunk int, formatted binary"


def format_chunks(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Consecutive formatted pieces of each conversation: ordered by (conv_id, part, chunk)."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("n"), F.coalesce(F.col(role), empty).alias("r"), F.coalesce(F.col(text), empty).alias("x")
    )
    dealt = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), "c", "n", *short_keys("r", "x")).sortWithinPartitions("c", "n", "r", "x")

    def fmt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            table = pa.Table.from_batches([b])
            step = max(1, int(b.num_rows * batch_bytes / max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                piece = table.slice(at, step).combine_chunks()
                c = piece["c"].combine_chunks() if isinstance(piece["c"], pa.ChunkedArray) else piece["c"]
                ends, buffer = assemble(_flat(piece["r"]), _flat(piece["x"]))
                ids, null = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)
                fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(ids)) - 1
                offsets = np.concatenate(([0], ends[last])).astype(np.int64)
                made = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), buffer])
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(first)), pa.array(np.full(len(first), part), pa.int32()), pa.array(seq + np.arange(len(first)), pa.int32()), made.cast(pa.binary())],
                    names=["conv_id", "part", "chunk", "formatted"],
                )
                seq += len(first)

    return dealt.mapInArrow(fmt, CHUNKS)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def parse_turns(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped; raises ValueError on anything else in between."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape_role(m[1].decode()), unescape(m[2].decode())))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


def format_conversations(turns: DataFrame, **kw) -> DataFrame:
    """The conversations as rows of (conv_id, part, chunk, formatted), whole turns in each."""
    return format_chunks(turns, **kw)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """A conversation's digests, fed one chunk after another."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.every, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, raw: bytes, loss_role: str) -> None:
        for r, x in parse_turns(raw):
            self.turns += 1
            self.every.update(f"{r}\n{x}\n".encode())
            if r == loss_role:
                self.loss_chars += len(x)
                self.loss.update(x.encode())
        self.chars += len(raw.decode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.every.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Digest each formatted conversation's turns and the texts under its loss mask.

    ``formatted``: rows of (conv_id, part, chunk, formatted).  Chunks are read in order and none is kept.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for c, raw in zip(b["conv_id"].to_pylist(), b["formatted"]):
                if now is None or c != now.conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Digest(c)
                now.add(raw.as_py(), loss_role)
            if rows:
                yield table(rows)
                rows = []
        if now is not None:
            yield table([now.row()])

    dealt = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return dealt.select("conv_id", "formatted").mapInArrow(digest, DIGESTS)
