"""A bit filter of 64-bit values: keeps rows away from a shuffle that a later join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import U64, map_arrow, mixed

#: Most bits of a filter (4 MB), which is sent to the executors. A fuller filter lets more rows
#: through to the join behind it, which alone decides; no row is lost at any size.
MOST_BITS = 1 << 25
PROBES = 4


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(values + U64(i * 0x632BE59BD9B4E019 % 2**64)) & U64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column, as 64-bit words; its size follows the rows up to MOST_BITS."""
    df = df.select(F.col(column).cast("long").alias("value")).filter("value is not null")
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(12, (12 * df.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(_places(batch["value"].to_numpy().view(U64), bits)))
            word, start = np.unique(found >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (found & 63).astype(U64), start) if len(found) else np.empty(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    out = np.zeros(bits // 64, dtype=U64)
    words = map_arrow(df, place, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    table = words.toArrow()  # at most MOST_BITS / 64 rows
    out[table["word"].to_numpy()] = table["value"].to_numpy().view(U64)
    return out


def passing(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the values may be in the filter."""
    hit = np.ones(len(values), dtype=bool)
    for place in _places(values, 64 * len(words)):
        hit &= (words[place >> 6] >> (place & 63).astype(U64) & U64(1)).astype(bool)
    return hit
