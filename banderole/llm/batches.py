"""Text work in Arrow batches.

Columns that a task doesn't make pass through as they came, so ids stay whole numbers next to
nulls (pandas would turn them into floats) and any type is carried.  Batches are cut by bytes, so a
task holds a few megabytes of text at a time however long the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20

#: Made once a task; turns texts (null: empty) into one Arrow array per new column.
Make = Callable[[], Callable[[list[str]], list[pa.Array]]]


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of about ``most`` bytes, one row at least."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def lists(raw: list[bytes], width: int) -> pa.Array:
    """Little-endian unsigned ids of ``width`` bytes each, one list of ints a row."""
    values = np.frombuffer(b"".join(raw), dtype=f"<u{width}").astype(np.int32)
    ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))) // width
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))


def kept_fields(df: DataFrame, gone: list[str]) -> list[T.StructField]:
    names = {x.lower() for x in gone}
    return [f for f in df.schema.fields if f.name.lower() not in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_columns(df: DataFrame, text: str, added: list[T.StructField], make: Make, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns that ``make`` derives from ``text``; a column that already has such a
    name is replaced by the new one, those in ``drop`` are left out."""
    kept = kept_fields(df, [*(f.name for f in added), *drop])
    source = "_text"
    while source in {f.name.lower() for f in kept}:
        source += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            for part in slices(b):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *of(texts_of(part.columns[-1]))], names=[*(f.name for f in kept), *(f.name for f in added)])

    rows = df.select(*(F.col(quoted(f.name)) for f in kept), F.col(quoted(text)).cast("string").alias(source))
    return rows.mapInArrow(run, T.StructType([*kept, *added]))


SHORT = 64


def short_keys(first: str, second: str) -> list[Column]:
    """Range keys that order rows as (first, second) does, up to rows that share long starts, which stay together.

    Spark samples range keys to the driver, so whole texts must not be keys.
    """
    start = F.substring(first, 1, SHORT)
    return [start, F.when(F.length(first) < SHORT, F.substring(second, 1, SHORT)).otherwise("")]
