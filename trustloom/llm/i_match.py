"""I-Match fingerprints: hashes of a text's middling-frequent terms, over randomised subsets of the lexicon.

The lexicon holds the terms whose inverse document frequency over all documents
lies in a band.  Each of three scales deals the lexicon to cells by a random
hash of the term, and keeps some of the cells as subsets: a subset of a coarse
scale holds 1/16 of the lexicon, then 1/256, then 1/4096.  A fingerprint is the
hash of a text's sorted distinct terms in each subset.  The likeness of two
fingerprints is the share of equal hashes among the subsets that hold terms of
either, at the scale where it is largest: short texts are told apart by the
coarse subsets, long ones by the fine ones.  A text without a term of the
lexicon takes all of its own terms instead.

Rows: null texts count as empty and have the fingerprint of no terms, which is
like itself only.  Rows without an id come last in the order of documents, by
text; rows that share an id are ordered by text; the last document's next one
is the first.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._bytes import utf8
from trustloom.llm._shared import bucket_of, id_buckets, parallelism, written
from trustloom.llm._worker import kept

#: The band: ln(documents / documents with the term), and at least two documents.
IDF_LOW, IDF_HIGH = 2.0, 7.0
#: (cells, subsets kept) of each scale.
SCALES = ((16, 16), (256, 32), (4096, 32))
SUBSETS = sum(k for _, k in SCALES)
EMPTY = "----"
#: Terms that may be sent to every task; a larger lexicon is joined instead.
MOST_BROADCAST = 400_000
CHUNK = 400_000

_APART = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms(raw: bytes) -> set[bytes]:
    """Distinct runs of ASCII letters, digits and bytes of other characters, A-Z lower-cased."""
    return set(raw.lower().translate(_APART).split())


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n) over all rows of a one-column table; tasks send one count for each term they saw."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            found = sorted(counts)
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([counts[t] for t in found], pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            offsets, data = utf8(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                counts.update(terms(raw[a:b]))
                if len(counts) > CHUNK:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """(term) of the band, by counts over all documents."""
    total = docs.count()
    least, most = max(2, math.ceil(total * math.exp(-high))), total * math.exp(-low)
    counts = document_frequencies(docs.where(F.col(text_col).isNotNull()).select(text_col))
    # in a small table the band may hold nothing: then it reaches down to the commonest terms
    return counts.where(F.col("n").between(least, max(least, most))).select("term")


def cells(term: bytes) -> tuple[int, ...]:
    """The subsets that a term belongs to."""
    h, at, out = xxhash.xxh3_128_intdigest(term), 0, []
    for n, kept in SCALES:
        cell = h % n
        h //= n
        if cell < kept:
            out.append(at + cell)
        at += kept
    return tuple(out)


def fingerprint(held: list[bytes], where=cells) -> str:
    """Four hexadecimal digits for each subset, of its sorted distinct terms."""
    subsets: dict[int, list[bytes]] = {}
    for term in sorted(held):
        for k in where(term):
            subsets.setdefault(k, []).append(term)
    return "".join(f"{xxhash.xxh3_64_intdigest(b' '.join(subsets[k])) & 0xFFFF:04x}" if k in subsets else EMPTY for k in range(SUBSETS))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if x == y:
        return 1.0
    best, at = 0.0, 0
    for _, kept in SCALES:
        either = same = 0
        for k in range(4 * at, 4 * (at + kept), 4):
            a, b = x[k : k + 4], y[k : k + 4]
            if a != EMPTY or b != EMPTY:
                either += 1
                same += a == b
        # one more subset that differs: a few subsets that agree by chance count for little
        best = max(best, same / (either + 1))
        at += kept
    return best


class _Lexicon:
    def __init__(self, held: list[bytes]):
        self.cells = {t: cells(t) for t in held}
        self.terms = frozenset(held)

    def print_of(self, raw: bytes) -> str:
        found = terms(raw)
        held = found & self.terms
        return fingerprint(held, self.cells.__getitem__) if held else fingerprint(found)


def _lexicon_of(broadcast) -> _Lexicon:
    return kept(f"lexicon {broadcast.id}", lambda: _Lexicon(broadcast.value.split(b"\n") if broadcast.value else []))


class _Broadcast:
    """A broadcast with a name that workers can keep what they made of it by."""

    def __init__(self, value):
        self.held, self.id = value, uuid.uuid4().hex

    @property
    def value(self):
        return self.held.value


def _known_terms(broadcast, raw: bytes) -> str:
    return _lexicon_of(broadcast).print_of(raw)


def fingerprints(docs: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row; found: the lexicon (default: of these documents)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    found = written(lexicon(docs, text_col) if found is None else found, "lexicon")
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if found.count() > MOST_BROADCAST:
        return _joined(texts, found, id_col)
    held = _Broadcast(spark.sparkContext.broadcast(b"\n".join(bytes(r.term) for r in found.collect())))

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            raw = data.tobytes()
            prints = [_known_terms(held, raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return texts.mapInArrow(run, f"{id_col} {kind.simpleString()}, fingerprint string")


def _joined(texts: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The same for a lexicon of any size: terms are looked up by a join, and rows put together again."""
    words = F.udf(lambda t: [bytearray(x) for x in terms((t or "").encode())], "array<binary>")
    rows = texts.select(F.monotonically_increasing_id().alias("nr"), id_col, words("text").alias("terms"))
    rows = written(rows, "terms")
    hits = rows.select("nr", F.explode("terms").alias("term")).join(found, "term").groupBy("nr").agg(F.collect_list("term").alias("held"))
    prints = F.udf(lambda held, own: fingerprint([bytes(x) for x in (held or own)]), "string")
    return rows.join(hits, "nr", "left").select(id_col, prints("held", "terms").alias("fingerprint"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, last, id, text: rows dealt by ranges of id, the first row of the next lower range repeated with last = 1.

    Sorted by part, last, id (descending) and text, each row's next document is the row after it.
    """
    spark = docs.sparkSession
    cuts = id_buckets(docs, id_col, parallelism(spark))
    rows = docs.select(bucket_of(id_col, cuts).alias("part"), F.lit(0).alias("last"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = sorted(tuple(r) for r in rows.select("part", "id").groupBy("part").agg(F.max("id")).collect())  # one for each range
    if heads:
        # the lowest range is followed by the highest one
        follows = {heads[k][0]: heads[(k + 1) % len(heads)][0] for k in range(len(heads))}
        to = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])
        firsts = [h for _, h in heads if h is not None]
        ghosts = rows.where(F.col("id").isin(firsts)) if firsts else rows.limit(0)
        if heads[0][1] is None:
            ghosts = ghosts.union(rows.where("id IS NULL").orderBy("text").limit(1))
        rows = rows.union(ghosts.select(to[F.col("part")].alias("part"), F.lit(1).alias("last"), "id", "text"))
    return rows.repartition(parallelism(spark), "part").sortWithinPartitions("part", "last", F.col("id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    found = written(lexicon(docs, text_col), "lexicon")
    if found.count() > MOST_BROADCAST:
        return _compare_joined(docs, found, id_col, text_col)
    held = _Broadcast(spark.sparkContext.broadcast(b"\n".join(bytes(r.term) for r in found.collect())))

    def run(batches):
        before = None
        for batch in batches:
            out = []
            for part, last, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if before is None or before[0] != part or not before[1]:
                    own = _known_terms(held, text.encode())
                    if before is not None and before[0] == part:
                        changed = _edited(before[3], text)
                        print_of = _known_terms(held, changed.encode())
                        out.append((before[2], len(before[3]), hashlib.sha256(changed.encode()).hexdigest(), before[4], print_of, likeness(before[4], print_of), likeness(before[4], own)))
                    before = (part, last, doc, text, own)
            yield _result(out, id_col)

    return edited_texts(docs, id_col, text_col).mapInArrow(run, _SCHEMA.format(id_col, kind.simpleString()))


_SCHEMA = "{} {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(out: list[tuple], id_col: str) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)


def _compare_joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """compare_edited for a lexicon that is too large to send: three texts a document, looked up by joins."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        before = None
        for batch in batches:
            out = []
            for part, last, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if before is None or before[0] != part or not before[1]:
                    if before is not None and before[0] == part:
                        out.append((before[2], before[3], _edited(before[3], text), text))
                    before = (part, last, doc, text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=[id_col, "text", "changed", "following"])

    rows = edited_texts(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, text string, changed string, following string")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "edited")
    prints = rows.select("row", id_col, F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"))
    for name, new in (("text", "fingerprint"), ("changed", "edited_fingerprint"), ("following", "following_fingerprint")):
        prints = prints.join(_joined(rows.select("row", F.col(name).alias("text")), found, "row").withColumnRenamed("fingerprint", new), "row")
    near = F.udf(likeness, "double")
    return prints.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("fingerprint", "edited_fingerprint").alias("near_edited"), near("fingerprint", "following_fingerprint").alias("near_next"))
