"""Row-wise work in Arrow batches: new columns beside those that a table has."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts handed over at a time hold about so many characters, so long ones don't pile up.
CHUNK_CHARS = 1_000_000


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from task to task, and would keep the peak of each."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 and so on: mapInArrow looks its input columns up by name, and dots in a name mislead it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list[list]]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` added. Input columns of the same names give way.

    ``make()`` runs once a task and returns the function from a list of texts (null: empty) to one list a field.
    """
    new = {f.name for f in fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c not in new]
    sent = [*kept, *([] if text in kept else [text])]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            done = 0
            for part in chunks([x or "" for x in batch.column(at).to_pylist()]):
                rows, done = batch.slice(done, len(part)), done + len(part)
                added = [pa.array(values, kind) for values, kind in zip(work(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *added], names=[*kept, *(f.name for f in fields)])
        work = batch = rows = added = part = None
        give_back()

    return numbered(df.select(*[df[f"`{c}`"] for c in sent])).mapInArrow(run, schema)
