"""Line dedup: two Bloom filters find the lines that may repeat, and only those shuffle.

1. Each task keeps two filters of its line hashes, of those seen in one document
   and of those seen in a second one, and emits their touched segments.  Merged
   by segment, a bit goes to the second filter if either task had it there or
   both had it in the first, so no line that two documents hold is missed.
2. Lines that the second filter knows are suspects.  Their 128-bit digests are
   grouped for the exact answer and the smallest doc_id.
3. Documents lose the confirmed lines that another document keeps.  The most
   common lines, a bounded number, are looked up where the documents are.

The filter has a fixed number of bits by the number of documents, at most
2**MOST_LOG2_BITS (128 MB); beyond the documents which that serves more lines
are suspects without need and shuffle, with the same result.

Rows: a null or empty text is one empty line; rows without doc_id pass
unchanged and keep nothing; rows that share a doc_id are one document; an empty
table gives an empty one; other columns are carried or ignored, never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._bytes import utf8
from trustloom.llm._shared import written
from trustloom.llm._worker import lean

WHITE = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 16
#: Texts that a task holds in several forms at once.
ROWS = 500
MOST_LOG2_BITS = 30
BITS_PER_DOCUMENT = 512
PROBES = 4
#: Lines that are sent to all tasks, at most (24 bytes each).
MOST_COMMON = 10_000


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or none if it has fewer than ``least`` code points."""
    key = line.strip(WHITE).lower()  # bytes.lower() changes A-Z only
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _probes(h: int, segments: int) -> tuple[int, list[int]]:
    at = [(h >> s) & 0xFFFF for s in (0, 16, 32)]
    at.append((h * 0x9E3779B97F4A7C15 >> 40) & 0xFFFF)
    return (h >> 40) % segments, at


def twice_filter(docs: DataFrame, id_col: str, text_col: str, least: int, segments: int):
    """Segments of the filter of hashes seen in two documents: (segment, bits)."""

    def local(batches):
        # bytes of the touched segments: at most the filter's size each, whatever the task reads
        once: dict[int, bytearray] = {}
        twice: dict[int, bytearray] = {}
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                keys = {k for line in raw[a:b].split(b"\n") if (k := line_key(line, least)) is not None}
                for key in keys:
                    segment, spots = _probes(xxhash.xxh3_64_intdigest(key), segments)
                    seen = once.get(segment)
                    if seen is None:
                        seen = once[segment] = bytearray(SEGMENT_BITS // 8)
                    if all(seen[x >> 3] >> (x & 7) & 1 for x in spots):
                        seen = twice.setdefault(segment, bytearray(SEGMENT_BITS // 8))
                    for x in spots:
                        seen[x >> 3] |= 1 << (x & 7)
        names = sorted(once)
        for k in range(0, len(names), 1024):
            part = names[k : k + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([zlib.compress(once[s], 1) for s in part], pa.binary()), pa.array([zlib.compress(twice[s], 1) if s in twice else None for s in part], pa.binary())],
                names=["segment", "once", "twice"],
            )

    def merge(batches):
        held, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([zlib.compress(twice, 1)], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for segment, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a = np.frombuffer(zlib.decompress(a), np.uint8)
                if segment != held:
                    if held is not None and twice.any():
                        yield done()
                    held, once, twice = segment, np.zeros_like(a), np.zeros_like(a)
                twice = twice | (once & a)
                once = once | a
                if b is not None:
                    twice = twice | np.frombuffer(zlib.decompress(b), np.uint8)
        if held is not None and twice.any():
            yield done()

    parts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col).mapInArrow(lean(local), "segment int, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(lean(merge), "segment int, bits binary")


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, known, id_col: str, text_col: str, least: int, segments: int) -> DataFrame:
    """(key digest, id) of each distinct line of a document that the second filter knows."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        bits = {s: zlib.decompress(b) for s, b in known.value.items()}
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            raw = data.tobytes()
            rows, found = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                keys = {k for line in raw[a:b].split(b"\n") if (k := line_key(line, least)) is not None}
                for key in keys:
                    segment, spots = _probes(xxhash.xxh3_64_intdigest(key), segments)
                    table = bits.get(segment)
                    if table is not None and all(table[x >> 3] >> (x & 7) & 1 for x in spots):
                        rows.append(row)
                        found.append(_digest(key))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["line", "id"])

    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(lean(run, ROWS), f"line binary, id {kind.simpleString()}")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id, lines array<binary>): digests of the lines that each document loses."""
    spark = docs.sparkSession
    wanted = max(1, docs.count() * BITS_PER_DOCUMENT)
    segments = 1 << max(2, min(MOST_LOG2_BITS, math.ceil(math.log2(wanted))) - 16)
    # the filter's size is bounded by MOST_LOG2_BITS
    known = spark.sparkContext.broadcast({r.segment: bytes(r.bits) for r in twice_filter(docs, id_col, text_col, least, segments).toLocalIterator()})
    found = written(suspects(docs, known, id_col, text_col, least, segments), "suspect-lines")
    confirmed = found.groupBy("line").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")).where("keeper < last").drop("last")
    confirmed = written(confirmed, "confirmed-lines")
    # lines with over 1 / MOST_COMMON of all rows: at most MOST_COMMON, so they may go to every task, and no task gets one whole
    common = found.count() // MOST_COMMON
    often, rest = confirmed.where(F.col("n") > common).drop("n"), confirmed.where(F.col("n") <= common).drop("n")
    lost = found.join(F.broadcast(often), "line").union(found.join(F.broadcast(often.select("line")), "line", "left_anti").join(rest, "line"))
    return lost.where("id > keeper").groupBy("id").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in keep, n_lines, n_dropped and kept_text (with ``digest``: kept_sha256 instead)."""
    last = "kept_sha256" if digest else "kept_text"
    names = [id_col, *keep]
    fields = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in names)

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            raw = data.tobytes()
            total, lost, kept = [], [], []
            for a, b, drop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist()):
                text = raw[a:b]
                total.append(text.count(b"\n") + 1)
                if drop:
                    drop = set(drop)
                    lines = text.split(b"\n")
                    stay = [x for x in lines if (k := line_key(x, least)) is None or _digest(k) not in drop]
                    lost.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    lost.append(0)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", last])

    drops = dropped_lines(docs, id_col, text_col, least).toDF("__id", "__lines")
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).join(drops, F.col(id_col) == F.col("__id"), "left")
    return rows.select(id_col, "__text", "__lines", *keep).mapInArrow(lean(run, ROWS), f"{fields}, n_lines long, n_dropped long, {last} string")


#: DuckDB SQL for the rows of op9.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, d.keeper IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
