"""Arrow batches of texts, cut so that a task holds little of the text at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Bytes of text worked on at once. A text beyond it is a piece of its own, never cut.
PIECE_BYTES = 1 << 19


def give_back_memory() -> None:
    """Return to the system what is free in this worker; later stages use the same worker again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Values of a string or binary column as bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a column of texts of about ``limit`` bytes each."""
    first, size = 0, 0
    for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += length
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def map_pieces(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[bytes | None]], list]],
    schema: T.StructType,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """Columns of ``df`` but ``text``, followed by what a function returns for each text.

    ``make`` runs once a task and returns the function: texts in, one Arrow-convertible
    column per field of ``schema`` out.
    """
    kept = [c for c in df.columns if c != text]
    out = T.StructType([*df.select(*kept).schema.fields, *schema.fields])
    names = [f.name for f in out.fields]
    at = df.columns.index(text)
    others = [i for i in range(len(df.columns)) if i != at]
    types = _arrow_types(schema)

    def run(stream):
        function = make()
        for batch in stream:
            texts = batch.column(at)
            for lo, hi in pieces(texts, limit):
                made = function(utf8(texts.slice(lo, hi - lo)))
                columns = [batch.column(i).slice(lo, hi - lo) for i in others]
                columns += [
                    c if isinstance(c, pa.Array) else pa.array(c, type=t)
                    for c, t in zip(made, types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                made = columns = None
            texts = batch = None
            give_back_memory()
        function = None
        give_back_memory()

    return df.mapInArrow(run, out)


def filter_pieces(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes | None]], list]]
) -> DataFrame:
    """Whole rows of ``df`` for which the function returns true; all columns stay as they are."""
    at = df.columns.index(text)

    def run(stream):
        function = make()
        for batch in stream:
            texts = batch.column(at)
            for lo, hi in pieces(texts):
                mask = pa.array(function(utf8(texts.slice(lo, hi - lo))), type=pa.bool_())
                yield batch.slice(lo, hi - lo).filter(mask)
            texts = batch = None
            give_back_memory()
        function = None
        give_back_memory()

    return df.mapInArrow(run, df.schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
