"""A bitmap of fixed size that marks 64-bit hashes: what isn't marked was never put in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def marks_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """Marks of a column of longs; the driver gets at most 2 ** ``bits`` bits, however many rows there are."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            marks[_place(batch.column(0).to_numpy(), bits)] = True
        words = np.packbits(marks, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "bits"])

    parts = hashes.coalesce(8).mapInArrow(packed, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), dtype="<i8")
    words[parts["at"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint8)


def marked(marks: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _place(hashes, bits)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
