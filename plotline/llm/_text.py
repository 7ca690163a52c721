"""Vectorised text kernels over Arrow string columns: word bounds, word hashes and per-document sums in numpy.

A *flat* text column is (data, off): all UTF-8 bytes of a batch in one uint8 array and int64 offsets per document.
Null texts count as empty. Words are maximal runs of bytes other than space and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Fixed odd multiplier of the rolling hash and its inverse modulo 2**64.
R = 0x9E3779B97F4A7C15
R_INV = pow(R, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A 64-bit value for every byte; upper and lower case ASCII letters share theirs.
BYTE_VALUE = splitmix(np.arange(1, 257, dtype=U) * U(R))[LOWER]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base, U)
        x[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(x)
    return have[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, off) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of the batches with at most ``most`` bytes of text each (one longer document stands alone)."""
    for batch in batches:
        data, off = flat(batch.column(text))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross documents: starts, ends, and for each document its first run."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = off[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = off[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of byte runs, equal for runs that have equal values, wherever they stand."""
    n = len(data)
    if len(starts) == 0:
        return np.empty(0, U)
    pre = np.empty(n + 1, U)
    pre[0] = 0
    np.cumsum(values[data] * powers(R, n), out=pre[1:])
    h = (pre[ends] - pre[starts]) * powers(R_INV, n)[starts]
    return splitmix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(IS_WORD[data], off)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each run, from the first run of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive values for each document (0 where it has none); a document's sum doesn't depend on its batch."""
    out = np.zeros(len(first) - 1)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64), first[:-1][some])
    return out


def joined(data: np.ndarray, starts: np.ndarray, size: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (by number) each with a space behind it, and where each one begins in these bytes."""
    size = size[kept]
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 32, np.uint8)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[place + np.repeat(at[:-1], size)] = data[place + np.repeat(starts[kept], size)]
    return out, at
