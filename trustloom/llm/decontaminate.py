"""Benchmark decontamination by templates.

Texts are cut into tokens; numbers, units and capitalised words become typed
placeholders.  Windows of 8 such tokens, at least 5 of them no placeholders,
are hashed and joined with those of the benchmark, and so are all windows of 8
case-folded tokens as they are, whatever their kinds: so a copy is found in any
case and with any share of names.  Windows that follow each other at one alignment of document and item form a run, and along a run each
slot of the item must be filled in one way, and no two by one filling: so an
item with other numbers and names is found, and text that only has its shape
is not.  A slot that breaks this ends the run behind the earlier slot that it
conflicts with.  A run of 13 tokens, or of the whole item if it is shorter, is a
leak; an item of under 8 tokens is only held against documents of its length.

Documents are read once, whatever the size of the benchmark, and their texts
never shuffle: a filter of the benchmark's windows lets the few windows pass
that it may hold, each with its own tokens, and these are joined by hash.  The
filter has at most 128 MB; a benchmark of over 2.8 million windows lets more
windows pass than need be, with the same result.

Rows: null texts, and items without tokens, match nothing; repeated items count
once; rows without doc_id are compared and reported like others, and so is each
of several equal rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm import _bloom
from trustloom.llm._bytes import LOWER, U64, mix, pieces, shingles, span_hashes, spans, utf8
from trustloom.llm._shared import written
from trustloom.llm._worker import lean

WINDOW, LITERALS, RUN = 8, 5, 13
#: Entries of the filter for each window: with 24 bits an entry, one of 36,000 other windows passes.
SPARSE = 16
WORD, NUMBER, UNIT, NAME = range(4)

UNITS = """m cm mm km mi ft yd kg mg g lb lbs oz t l ml gal s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles
foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres
gallon gallons dollar dollars cent cents euro euros usd eur gbp percent degree degrees volt volts watt watts joule joules
newton newtons pascal pascals mph kmh hz khz mhz ghz kb mb gb tb""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHAPE = mix(np.arange(4, dtype=np.uint64) + U64(0xC0FFEE))


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    inside = _INSIDE[raw]
    starts, _ = spans(inside, np.array([0, len(raw)]))
    return np.unique(span_hashes(raw, starts, inside))


_UNITS, _NUMBERS = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS)


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _folded(offsets: np.ndarray, data: np.ndarray):
    """Offsets and bytes of the texts without case, in any script; every token stays one token."""
    if not (data >= 128).any():
        return offsets, LOWER[data]
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    text = pc.utf8_lower(text)
    for one, other in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        text = pc.replace_substring(text, one, other)
    return utf8(text)


def _inside_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which bytes belong to tokens."""
    inside = _INSIDE[data]
    if len(data) > 2:
        # a point or comma between digits belongs to the number
        digit = _DIGIT[data]
        inside[1:-1] |= ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        for edge in (cut, cut - 1):
            inside[edge] &= _INSIDE[data[edge]]
    return inside


def tokens(offsets: np.ndarray, data: np.ndarray):
    """Of each token: its row, its kind, the hash of its case-folded text, and the hash of its template."""
    inside = _inside_of(offsets, data)
    starts, rows = spans(inside, offsets)
    plain_offsets, folded = _folded(offsets, data)
    held = _inside_of(plain_offsets, folded)
    raw = span_hashes(folded, spans(held, plain_offsets)[0], held)
    if not len(starts):
        return rows, np.zeros(0, np.int8), raw, raw
    other = inside & ~_DIGIT[data] & (data != 0x2E) & (data != 0x2C)
    plain = np.add.reduceat(other[starts[0] :].astype(np.int64), starts - starts[0]) > 0
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    kind = np.where(capital, NAME, WORD).astype(np.int8)
    kind[_among(raw, _UNITS)] = UNIT
    kind[_among(raw, _NUMBERS) | ~plain] = NUMBER
    return rows, kind, raw, np.where(kind == WORD, raw, _SHAPE[kind])


def windows(rows: np.ndarray, kind: np.ndarray, raw: np.ndarray, template: np.ndarray, n_rows: int):
    """Hashes of the windows to join, their rows and their places in them.

    They are the template windows with enough literal words, and all windows of
    case-folded tokens; the two are the same where no token is a placeholder.
    """
    found, bounds = shingles(rows, template, n_rows, WINDOW)
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.diff(bounds)
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(len(found))
    size = np.repeat(np.minimum(np.diff(first), WINDOW), counts)
    literal = np.concatenate([[0], np.cumsum(kind == WORD)])
    enough = literal[at + size] - literal[at] >= np.minimum(LITERALS, np.maximum(1, size - (WINDOW - LITERALS)))
    # the same bounds: they follow from the numbers of tokens
    folded, _ = shingles(rows, raw, n_rows, WINDOW)
    row = np.repeat(np.arange(n_rows), counts)
    place = np.arange(len(found)) - bounds[row]
    keep = np.flatnonzero(enough & (found != folded))
    return np.concatenate([found[keep], folded]), np.concatenate([row[keep], row]), np.concatenate([place[keep], place])


def _table(columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _slices(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    raw, width = values.tobytes(), values.dtype.itemsize
    return pa.array([raw[a * width : (a + n) * width] for a, n in zip(begin.tolist(), size.tolist())], pa.binary())


_WINDOWS = "hash long, item long, said long, place long, n_item long, own binary, kinds binary"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Of (item, said, text) each window: its hash and place, the item's tokens, and the window's own with their kinds."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for row, at, part in pieces(offsets, data):
                n = len(at) - 1
                rows, kind, raw, template = tokens(at, part)
                found, which, place = windows(rows, kind, raw, template, n)
                first = np.searchsorted(rows, np.arange(n + 1))
                total = np.diff(first)[which]
                begin, size = first[which] + place, np.minimum(total, WINDOW)
                of = pa.array(row + which)
                yield _table([pa.array(found.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(place), pa.array(total), _slices(raw, begin, size), _slices(kind, begin, size)], ["hash", "item", "said", "place", "n_item", "own", "kinds"])

    return items.mapInArrow(lean(run), _WINDOWS)


def suspected_windows(docs: DataFrame, held) -> DataFrame:
    """Of (row, id, text) each window that the filter knows: row, id, hash, at (its place), doc (its tokens)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        segments, bits = held.value
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for row, at, part in pieces(offsets, data):
                n = len(at) - 1
                rows, sort, raw, template = tokens(at, part)
                found, which, place = windows(rows, sort, raw, template, n)
                hits = np.flatnonzero(_bloom.known(found, segments, table))
                first = np.searchsorted(rows, np.arange(n + 1))
                which, place = which[hits], place[hits]
                of = pa.array(row + which)
                doc = _slices(raw, first[which] + place, np.minimum(np.diff(first)[which], WINDOW))
                yield _table([batch.column(0).take(of), batch.column(1).take(of), pa.array(found[hits].view(np.int64)), pa.array(place), doc], ["row", "id", "hash", "at", "doc"])

    return docs.mapInArrow(lean(run), f"row long, id {kind}, hash long, at long, doc binary")


def longest_run(found) -> tuple[int, bool]:
    """Tokens of the longest consistent run of the windows at one alignment, and whether no slot is filled anew.

    found: (place in the document, tokens there, the item's tokens, their kinds), by place.
    """
    best, begin, last, anew = (0, False), 0, None, -1
    # of each slot and filling: its partner, and the last place of the two
    there: dict = {}
    back: dict = {}
    for p, docs, owns, sorts in found:
        docs, owns = np.frombuffer(docs, np.uint64).tolist(), np.frombuffer(owns, np.uint64).tolist()
        if last is None or p > last:  # the window doesn't continue the one before
            begin = last = p
        for at in range(last, p + len(docs)):
            doc, own, sort = docs[at - p], owns[at - p], sorts[at - p]
            if sort != WORD:
                for held, one, other in ((there, own, doc), (back, doc, own)):
                    partner, place = held.get((sort, one), (other, -1))
                    if partner != other:  # the run goes on behind the earlier slot
                        begin = max(begin, place + 1)
                    held[sort, one] = other, at
                if doc != own:
                    anew = at
            best = max(best, (at + 1 - begin, anew < begin))
        last = p + len(docs)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, item_id, n_matched, n_item, coverage, exact) of every document and item of which it holds a run.

    row_col: a column of longs that tells rows apart; with it the rows' numbers
    are returned too, in front, under its name.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    held = written(benchmark_windows(items.select("item", F.xxhash64("text").alias("said"), "text")), "benchmark-windows")
    known = docs.sparkSession.sparkContext.broadcast(_bloom.build(held.select("hash"), lambda b: np.asarray(b.column(0)).view(np.uint64), SPARSE * held.count()))
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    # all windows of a document come from one task, so the number that it gives a row holds for them all
    texts = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = suspected_windows(texts, known).join(held, "hash").where(F.length("doc") == F.length("own"))
    found = found.select("row", "item", "said", (F.col("at") - F.col("place")).alias("shift"), "at", "id", "n_item", "doc", "own", "kinds")
    names = ["row", id_col, "item_id", "n_matched", "n_item", "coverage", "exact"]

    def run(batches):
        done: list[tuple] = []
        id_type: list[pa.DataType] = []

        def batch_of():
            types = (pa.int64(), id_type[0], pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            columns = [pa.array([x[k] for x in done], t) for k, t in enumerate(types)]
            done.clear()
            return _table(columns, names)

        def seen():
            for b in batches:
                if not id_type:
                    id_type.append(b.column(5).type)
                yield from zip(*(b.column(k).to_pylist() for k in range(10)))

        for (row_, item, _), windows_ in groupby(seen(), lambda x: x[:3]):
            best, total, id_ = (0, False), 0, None
            for _, aligned in groupby(windows_, lambda x: x[3]):
                # a window of either sort at a place is one
                firsts = [next(same) for _, same in groupby(aligned, lambda x: x[4])]
                id_, total = firsts[0][5], firsts[0][6]
                best = max(best, longest_run((x[4], *x[7:]) for x in firsts))
            if best[0] >= min(RUN, total):
                done.append((row_, id_, item, best[0], total, best[0] / total, best[1]))
                if len(done) >= 5000:
                    yield batch_of()
        if done:
            yield batch_of()

    order = ["row", "item", "said", "shift", "at"]
    # rows of one document and item meet; their number is bounded by the document's length times the alignments it has with the item
    out = found.repartition("row", "item", "said").sortWithinPartitions(*order).mapInArrow(lean(run), f"row long, `{id_col}` {kind}, item_id long, n_matched long, n_item long, coverage double, exact boolean")
    return out.drop("row") if row_col is None else out.withColumnRenamed("row", row_col)
