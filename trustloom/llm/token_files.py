"""Token ids in binary files: one zstandard frame a document, a trailing seek table, checksums.

A file is a sequence of independent frames, each the ids of one document as
little-endian unsigned 32-bit integers; a skippable frame with the documents'
ids; and a skippable frame with the seek table of the public seekable
zstandard format (compressed size, decompressed size and the low 32 bits of
XXH64 of each frame).  Any zstandard tool can unpack it, and a reader gets one
document by reading the table and that document's frame.

Documents are dealt to files by ranges of doc_id and written in ascending
doc_id order (equal ids by text), so token offsets follow from the files'
totals.  A task writes under a name of its own and renames when the file is
whole: a task that runs again after a loss leaves the same file.

A special token's text inside a document becomes that token, as the library
does it.  Rows: null texts count as empty and give the end id alone; rows without doc_id
come first; an empty table gives no files and no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm._bytes import LOWER, pieces, utf8
from trustloom.llm._shared import bucket_of, fresh_path, id_buckets, parallelism
from trustloom.llm._units import LETTER, MARK, WHITE, TokenPool, hashed_units
from trustloom.llm._worker import kept

# Fixed values of the public seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
# A skippable frame of our own, of the magic numbers set aside for users.
IDS_MAGIC = 0x184D2A50
NO_ID = -(2**63)


class FrameWriter:
    """Writes one file to any byte sink."""

    def __init__(self, sink, level: int = 1):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.entries, self.ids = [], []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        frame = self.zip.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.tokens += len(ids)

    def close(self) -> None:
        held = np.array(self.ids, "<i8").tobytes()
        self.sink.write(struct.pack("<II", IDS_MAGIC, len(held)) + held)
        table = b"".join(struct.pack("<III", *x) for x in [*self.entries, (len(held) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)])
        self.sink.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.entries) + 1, CHECKSUM_FLAG, SEEK_FOOTER_MAGIC))
        self.sink.close()


class FrameReader:
    """Reads single documents of a file: ``source`` is open for random access."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        begins = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        self.table, self.begins = table[:-1], begins
        self.doc_ids = np.frombuffer(self._at(int(begins[n - 1]) + 8, int(table[-1, 0]) - 8), "<i8")
        self.counts = self.table[:, 1].astype(np.int64) // 4
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, where: int, size: int) -> bytes:
        self.source.seek(where)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is read."""
        raw = self.unzip.decompress(self._at(int(self.begins[k]), int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[k, 2]):
            raise ValueError(f"checksum of frame {k} is wrong")
        return np.frombuffer(raw, "<u4")

    def document(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        if k == len(self.doc_ids) or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.frame(k)


class WordBpe:
    """A tokenizers-library vocabulary that drops white space, with the cache of one worker."""

    WORD_END = "</w>"

    def __init__(self, held: str):
        from tokenizers import Tokenizer

        # units are lower-cased, so none of them may become a special token; texts that hold one go whole to the library
        self.held, self.tokenizer = held, Tokenizer.from_str(held)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for text, k in self.tokenizer.get_vocab().items():
            self.ends[k] = text.endswith(self.WORD_END)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.pool = TokenPool(self._encode_units, self.dtype)

    def _encode_units(self, units: list[bytes], kinds: list[int]) -> list[list[int]]:
        out: list = [None] * len(units)
        # a run of letters or marks is one pre-token; its last token ends a word
        single = [k for k, kind in enumerate(kinds) if kind in (LETTER, MARK)]
        if single:
            ids = np.array(self.tokenizer.encode(b" ".join([units[k] for k in single]).decode(), add_special_tokens=False).ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(single):
                begin = 0
                flat = ids.tolist()
                for k, end in zip(single, cut.tolist()):
                    out[k] = flat[begin:end]
                    begin = end
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch([units[k].decode() for k in rest], add_special_tokens=False)):
                out[k] = e.ids
        return out

    @functools.cached_property
    def whole(self):
        """The library as it is: special tokens in a text are taken for what they are."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.held)

    def _with_special(self, offsets: np.ndarray, data: np.ndarray) -> set[int]:
        """Rows that hold a special token's text."""
        raw, rows = data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        return rows

    def encode_rows(self, offsets: np.ndarray, data: np.ndarray):
        """Token ids of each row of a piece."""
        special = {k: self.whole.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids for k in self._with_special(offsets, data)}
        data = LOWER[data]
        starts, lengths, kinds, hashes = hashed_units(offsets, data, False)
        word = kinds != WHITE
        starts, lengths, kinds, hashes = starts[word], lengths[word], kinds[word], hashes[word]
        ids, counts = self.pool.tokens(self.pool.lookup(data, starts, lengths, kinds, hashes))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        for k in range(len(offsets) - 1):
            yield np.array(special[k], self.dtype) if k in special else ids[ends[k] : ends[k + 1]]


def _codec(broadcast) -> WordBpe:
    name, text = broadcast.value
    return kept(f"word-bpe {name}", lambda: WordBpe(text))


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes the table's files and returns, by file: shard, path, n_docs, n_tokens, start (tokens before it).

    The number of files (default: four for each shuffle partition) bounds the
    rows of this list, which passes through the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    held = spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))
    files = files or 4 * parallelism(spark)

    def run(batches):
        codec = _codec(held)
        shard, place, partial, writer = None, None, None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        done = []

        def close():
            writer.close()
            fs.move(partial, place)
            done.append((shard, f"{folder}/{place.rsplit('/', 1)[1]}", len(writer.ids), writer.tokens))

        tail = np.array([end_id], codec.dtype)
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            shards, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, at, part in pieces(offsets, data):
                for k, ids in enumerate(codec.encode_rows(at, part), row):
                    if shards[k] != shard:
                        if writer:
                            close()
                        shard = shards[k]
                        place = f"{base}/ids-{shard + 1:06d}.zst"
                        partial = f"{place}.{uuid.uuid4().hex}"
                        writer = FrameWriter(fs.open_output_stream(partial, buffer_size=1 << 20))
                    writer.add(doc_ids[k], np.concatenate([ids, tail]))
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_tokens"])

    cuts = id_buckets(docs, id_col, files)
    rows = docs.select(bucket_of(id_col, cuts).alias("shard"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = rows.repartition(max(parallelism(spark), files // 2), "shard").sortWithinPartitions("shard", "id", "text").mapInArrow(run, "shard int, path string, n_docs long, n_tokens long")
    start, found = 0, []
    for r in sorted(listed.collect()):
        found.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(found, "shard int, path string, n_docs long, n_tokens long, start long")


def read_files(listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: id, start, n_tokens, ids_crc32, of each document, by the seek tables."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, base = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(base) as source:
                    reader = FrameReader(source)
                    begins = start + np.cumsum(reader.counts) - reader.counts
                    for k in range(0, len(reader), 4096):
                        part = slice(k, min(k + 4096, len(reader)))
                        crc = [zlib.crc32(reader.frame(x)) for x in range(part.start, part.stop)]
                        ids = reader.doc_ids[part]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(begins[part], pa.int64()), pa.array(reader.counts[part], pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    n = parallelism(listed.sparkSession)
    return listed.select("path", "start").repartition(n).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def tokens_on_file(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    return read_files(write_files(docs, fresh_path(spark, "token-files"), tokenizer, end_id))
