"""Fill-in-middle transformation.

A text is cut at two of its code point boundaries into prefix, middle and suffix, and written with
sentinels so that a left-to-right model learns to fill the middle: ``psm`` is
``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the text.

Code point offsets come from the tokenizers library's Split pre-tokenizer with isolated regular
expression matches, untrained.  A match for every code point costs 2.2 microseconds each, so there are two levels:
matches of ``BLOCK`` code points give an offset array whose length (with the end of its last match)
gives n, and the match that holds a cut is split again into single code points, whose ranked
offset gives the slice.  A text is split in segments of ``SEGMENT`` code points, so the offsets in memory don't
grow with its length.

Choices are a function of (seed, key) alone: h1 to h4 are the first four 8-digit groups of the hex
SHA-256 of ``seed:key``.  Cuts are h1 % (n + 1) and h2 % (n + 1), the smaller first; h3 % 100 >= ``plain_from``
leaves a text as it is, h4 % 100 < ``spm_below`` takes spm.

Edge cases: a null text is empty; an empty text and one that holds a sentinel stay plain (so that
the inverse needs no escapes); a null key counts as the empty string; repeated rows are transformed alike;
no rows give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import quoted, slices, texts_of

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLOCK = 64
SEGMENT = 1 << 20


class Cutter:
    """Code point counts and cuts by the offsets of isolated matches."""

    def __init__(self, block: int = BLOCK, segment: int = SEGMENT):
        from tokenizers import Regex, pre_tokenizers

        self.block, self.segment = block, segment
        self.blocks = pre_tokenizers.Split(Regex(r"[\s\S]{1,%d}" % block), behavior="isolated")
        self.points = pre_tokenizers.Split(Regex(r"[\s\S]"), behavior="isolated")

    def length(self, text: str) -> int:
        """n, from the length of the offset array of each segment."""
        n = 0
        for at in range(0, len(text), self.segment):
            offsets = self.blocks.pre_tokenize_str(text[at : at + self.segment])
            start, end = offsets[-1][1]
            n += self.block * (len(offsets) - 1) + end - start
        return n

    def offset(self, text: str, rank: int, n: int) -> int:
        """Where the code point of this rank starts; n has the end of the text."""
        if rank == n:
            return len(text)
        at = rank // self.block * self.block
        return at + self.points.pre_tokenize_str(text[at : at + self.block])[rank - at][1][0]


def hashes(key: Column, seed: int) -> list[Column]:
    """h1 to h4 of (seed, key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every text, transformed or plain."""
    h = hashes(F.col(quoted(key)), seed)
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    made = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    schema = T.StructType([rows.schema["key"], *made.fields])

    def one(cut: Cutter, text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        n = cut.length(text)
        if not n or h3 % 100 >= plain_from or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = cut.offset(text, first, n), cut.offset(text, second, n)
        if h4 % 100 < spm_below:
            return n, "spm", first, second - first, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
        return n, "psm", first, second - first, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, kinds = Cutter(), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for part in slices(b):
                out = [one(cut, *row) for row in zip(texts_of(part.column("text")), *(part.column(f"h{i}").to_pylist() for i in range(1, 5)))]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: sentinels occur nowhere else in a transformed text."""

    def after(x: Column, sentinel: str) -> Column:
        return x.substr(F.length(F.substring_index(x, sentinel, 1)) + len(sentinel) + 1, F.length(x))

    def before(x: Column, sentinel: str) -> Column:
        return F.substring_index(x, sentinel, 1)

    rest = output.substr(F.lit(len(PREFIX) + 1), F.length(output))
    psm = F.concat(before(rest, SUFFIX), after(rest, MIDDLE), before(after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(rest, MIDDLE), before(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
