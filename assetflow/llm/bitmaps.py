"""A bitmap of hashed keys, of one size whatever the data, that spares shuffling other rows.

A row whose bit is not set has none of the keys; one whose bit is set may have, and is then
joined exactly. So a full bitmap only saves less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25  # 4 MB


def _place(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def build(keys: DataFrame, key: str):
    """Broadcast bitmap of a column's values; the driver gets at most ``BITS`` / 64 numbers."""
    place = _place(key)
    words = (
        keys.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def select(df: DataFrame, key: str, bitmap, present: bool) -> DataFrame:
    """The rows of ``df`` whose bit is set, or those whose is not; all columns stay."""
    schema, n = df.schema, len(df.columns)

    def run(stream):
        bits = bitmap.value
        for batch in stream:
            place = batch.column(n).to_numpy(zero_copy_only=False).astype(np.uint64)
            is_set = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            kept = pa.RecordBatch.from_arrays(batch.columns[:n], names=schema.names)
            yield kept.filter(pa.array(is_set if present else ~is_set))

    # Beside the columns, whatever they are called.
    return df.select("*", _place(key)).mapInArrow(run, schema)
