"""Words of many texts at once, as byte positions and hashes in arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Words:
    """Bytes of all texts in a row; of each word its first byte, the byte after its last, its text and a hash."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    #: first word of every text, and the number of words behind them
    first: np.ndarray


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(30))
    hashes = hashes * _MIX
    hashes ^= hashes >> np.uint64(27)
    hashes *= np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def _powers(count: int) -> np.ndarray:
    out = np.full(max(count, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of a string or binary column in a row, and where each value begins; a null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return b"", np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return (held[int(offsets[0]) : int(offsets[-1])].to_pybytes() if held else b""), offsets - offsets[0]


def words_of(column: pa.Array, table: bytes, separators: bytes) -> Words:
    """Words of every text after ``table`` was applied to its bytes; a word is a run without separators (ASCII only)."""
    data, offsets = buffers(column)
    data = data.translate(table)
    count = len(offsets) - 1
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    inside = inside[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    follows = np.zeros(len(raw), dtype=bool)
    follows[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~follows | edge[:-1]))
    follows[:-1] = inside[1:]
    follows[-1:] = False
    ends = np.flatnonzero(inside & (~follows | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, starts, ends, text, np.empty(0, dtype=np.uint64), first)
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(raw))))
    place = np.arange(starts[0], len(raw)) - starts[number]
    longest = int((ends - starts).max())
    weights = _powers(longest + 1)[np.minimum(place, longest)]
    weights *= (raw[starts[0] :].astype(np.uint64) + np.uint64(1)) * inside[starts[0] :]
    return Words(data, starts, ends, text, mixed(np.add.reduceat(weights, starts - starts[0])), first)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word."""
    count = max(len(hashes) - size + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(size):
        out += hashes[k : k + count] * factors[k]
    return mixed(out)
