"""Numpy on whole Arrow batches of text: bytes, words, rolling hashes, packed columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bondsight.llm.shared import BATCH_BYTES

U = np.uint64
#: Odd multipliers of the rolling hashes.
BASE = 0x9E3779B97F4A7C15
OTHER = 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each part has about `limit` bytes of the column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum() if len(batch) else []
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row's begin (one offset more than rows). Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, off - off[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits, one to one."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=U)
    return _powers[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefixes(values: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp sums over every prefix of the values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values)), dtype=U, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The hash of each span [start, end), wherever it stands."""
    return (sums[end] - sums[start]) * powers(inverse(base), len(sums))[start]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word between white space, and the first word's number of each row (one more than rows)."""
    solid = ~SPACE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.concatenate([[False], solid[:-1]])
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.concatenate([solid[1:], [False]])
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = spans_hash(prefixes(data.astype(U) + U(1), BASE), start, end, BASE)
    return mixed(h ^ (end - start).astype(U) * U(OTHER))


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window of `size` words inside one row, and its row. first: as of words()."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), row


def windows_hash(hashes: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    return mixed(spans_hash(prefixes(hashes, base), at, at + size, base))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.subtract.at(d, end, 1)
    return np.cumsum(d)[:n] > 0


def binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column; row i holds the little-endian values off[i] to off[i + 1]."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The other way round: values and offsets of a column made by binary()."""
    data, off = flat(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), off // size


def runs(codes: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def joined(data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, stay: np.ndarray) -> list[bytes]:
    """Each row's staying words, joined by one space. start, end, first: as of words(); a word's gap lends the space."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))[stay]
    start, end = start[stay], end[stay]
    gap = start[1:][row[1:] == row[:-1]] - 1
    out, mask = data.copy(), np.zeros(len(data) + 1, np.int8)
    out[gap] = 0x20
    mask[start] += 1
    np.subtract.at(mask, end, 1)
    keep = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    keep[gap] = True
    ends, kept = np.concatenate([[0], np.cumsum(keep)])[off], out[keep].tobytes()
    return [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
