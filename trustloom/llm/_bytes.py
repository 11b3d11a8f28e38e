"""Vectorised work on UTF-8 bytes of Arrow batches, shared by the operators.

All hashes are 64-bit and depend on bytes alone, so every executor computes
the same ones.  Work is cut into pieces of 256 KB: the temporary
arrays of a piece are its size times a constant, whatever the batch holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 18

_rng = np.random.default_rng(0x5EED)
#: A random odd 64-bit value for each byte value.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


class PowerTable:
    """Powers of one base, kept for the life of the worker and grown when asked."""

    def __init__(self, base: int):
        self.base, self.values = base, powers(base, 1024)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = powers(self.base, max(n, 2 * len(self.values)))
        return self.values[:n]


POWERS, INVERSES = PowerTable(BASE), PowerTable(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and the bytes of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], held[at[0] : at[-1]]


def pieces(offsets: np.ndarray, data: np.ndarray, most: int = PIECE_BYTES):
    """Runs of rows of at most ``most`` bytes (a longer row stands alone): first row, offsets from 0, bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the maximal runs of true bytes within a row, and the row of each."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(inside), bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    cut = offsets[:-1]
    fresh[cut[cut < len(inside)]] = True
    starts = np.flatnonzero(inside & fresh)
    return starts, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """A hash of each span; a span runs to the next start, bytes outside of ``inside`` don't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    part = BYTE_VALUES[data[starts[0] :]] * POWERS(int(lengths.max()))[place]
    if inside is not None:
        part *= inside[starts[0] :]
    return mix(np.add.reduceat(part, starts - starts[0]))


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, rows and hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    data = LOWER[data]
    inside = ~SPACE[data]
    starts, rows = spans(inside, offsets)
    return starts, rows, span_hashes(data, starts, inside)


_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles in order, and where each row's begin (n_rows + 1 values).

    A row of one to ``width - 1`` words has one shingle, its whole sequence.
    """
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(counts, width), made).astype(np.uint64)
    total = length * U64(0xD6E8FEB86659FD93)
    for k in range(width):
        held = length > k
        total += np.where(held, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] * _PLACE[k], U64(0)) if len(hashes) else U64(0)
    return mix(total), bounds


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[begin:begin+length] of each entry, end to end."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    shift = begin - (np.cumsum(length) - length)
    return pool[np.repeat(shift, length) + np.arange(total)]
