"""A Bloom filter of well mixed 64-bit hashes of any table, built where the rows are and merged by segment.

Its size follows the number of entries up to a fixed bound; beyond that it
lets more rows pass, so it may only stand before an exact step.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trustloom.llm._bytes import U64

SEGMENT_BITS = 1 << 16
MOST_LOG2_BITS = 30


def _bits(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (hashes >> U64(40)).astype(np.int64) & (segments - 1), (hashes & U64(0xFFFF)).astype(np.int64), (hashes >> U64(16) & U64(0xFFFF)).astype(np.int64)


def build(rows: DataFrame, hashed: Callable[[pa.RecordBatch], np.ndarray], entries: int) -> tuple[int, bytes]:
    """(segments, bits) of the filter of a table; ``hashed`` gives the 64-bit hashes of a batch of its rows."""
    segments = 1 << max(0, min(MOST_LOG2_BITS, math.ceil(math.log2(max(1, 24 * entries)))) - 16)

    def local(batches):
        found = [hashed(b) for b in batches]
        if not found:
            return
        segment, a, b = _bits(np.unique(np.concatenate(found)), segments)
        order = np.argsort(segment, kind="stable")
        segment, a, b = segment[order], a[order], b[order]
        cut = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        names, packed = segment[cut], []
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(segment)]):
            bits = np.zeros(SEGMENT_BITS, np.uint8)
            bits[a[x:y]] = bits[b[x:y]] = 1
            packed.append(zlib.compress(np.packbits(bits, bitorder="little"), 1))
        for k in range(0, len(packed), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 1024].astype(np.int32)), pa.array(packed[k : k + 1024], pa.binary())], names=["segment", "bits"])

    def merge(batches):
        held, bits = None, None
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if segment != held:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], names=["segment", "bits"])
                    held, bits = segment, np.zeros(SEGMENT_BITS // 8, np.uint8)
                bits = bits | np.frombuffer(zlib.decompress(packed), np.uint8)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], names=["segment", "bits"])

    merged = rows.mapInArrow(local, "segment int, bits binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in merged.toLocalIterator():  # at most 2**MOST_LOG2_BITS bits in all
        out[r.segment] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return segments, out.tobytes()


def known(hashes: np.ndarray, segments: int, table: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; table: its bits as bytes."""
    segment = (hashes >> U64(40)).astype(np.int64) & (segments - 1)
    at = segment * (SEGMENT_BITS // 8)
    out = np.zeros(len(hashes), bool)
    bit = (hashes & U64(0xFFFF)).astype(np.int64)
    near = np.flatnonzero(table[at + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1)
    bit = (hashes[near] >> U64(16) & U64(0xFFFF)).astype(np.int64)
    out[near] = table[at[near] + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1
    return out
