"""Suffix-array dedup: remove every byte that a long string with a second occurrence covers.

Sorting all suffixes of a corpus writes each position several times over, so
the cover of positions is chosen by content, not by position modulo three: a
window of ``length`` bytes has its sample at the leftmost smallest hash of its
128-byte strings.  Like a difference cover it has the property that two equal
windows hold a sample at the same offset; it holds one position in 137.

1. Samples are named by their 128 bytes, and within a name by the whole string
   that windows with this sample span (its context).  Names that occur once
   end here; all windows of a context that occurs twice are repeats.
2. Names with more contexts than one sort takes are recursed on: the windows of
   a context are halved by their distance from the sample, and each half is
   named by the string that all windows of it hold.  Halves with a name of
   their own end, equal halves are repeats, and at single windows nothing is
   left, so a name of any number of contexts ends as names of bounded size.
3. One context of each name and kind travels to the name's task.  There the
   difference-cover algorithm proper (triples at positions not divisible by
   three, recursion on their names, merge with the rest) sorts the suffixes of
   the contexts, and windows are compared with their neighbours in that order.
4. The repeated windows of a context hold for all documents that have it.

Hashes of strings have 64 bits; a row's name has 96.  Rows: null texts count as
empty; a text shorter than ``length`` loses nothing; rows without an id and
rows that share an id are told apart by their text; equal rows count as two
occurrences; an empty table gives no rows; other columns are ignored.  Matches
never cross documents.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm import _bloom
from trustloom.llm._bytes import BYTE_VALUES, INVERSES, POWERS, SPACE, U64, mix, pieces, utf8, words
from trustloom.llm._shared import written

SAMPLE = 128
SEGMENT = 1 << 18
#: Bytes of contexts that are sorted at once; names with more are recursed on.
SORTED = 1 << 19
#: Words of the sampled strings of ``shared_strings``.
SHINGLE = 32
_POSITION = U64((1 << 24) - 1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by the difference cover {1, 2} modulo 3; symbols are >= 0."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    size = int(s.max()) + 1
    # sort the sampled triples and name them; a text of length 1 mod 3 gets one more sample, the empty suffix
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (s[sample] * size + s[sample + 1]) * size + s[sample + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.append(True, np.diff(triple[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh) - 1
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    wide = len(sample) + 2
    # the remaining suffixes: first symbol, then the rank of what follows
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(s[zero] * wide + rank[zero + 1], kind="stable")]
    # merge: how many samples of either kind come before each of them
    ordered = sample[order]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    first, second = first[first < n], second[second < n]
    before = np.searchsorted(s[first] * wide + rank[first + 1], s[zero] * wide + rank[zero + 1])
    before += np.searchsorted((s[second] * size + s[second + 1]) * wide + rank[second + 2], (s[zero] * size + s[zero + 1]) * wide + rank[zero + 2])
    at = before + np.arange(len(zero))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = ordered[ordered < n]
    return out


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * POWERS(len(data)), out=total[1:])
    return total


def _string_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], comparable across texts."""
    return mix((total[end] - total[begin]) * INVERSES(len(total))[begin])


def samples(offsets: np.ndarray, data: np.ndarray, length: int):
    """Of each sample of a piece: row, first and last window that has it, its place (positions in the piece), name, context."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = _prefix_hashes(data)
    at = np.arange(n - SAMPLE + 1)
    grams = _string_hashes(total, at, at + SAMPLE)
    key = (grams & ~_POSITION) | at.astype(np.uint64)
    width = length - SAMPLE + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    place = (np.minimum(tail[:starts], head[width - 1 : width - 1 + starts]) & _POSITION).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    window = np.flatnonzero(np.arange(length, length + starts) <= offsets[rows + 1])
    if not len(window):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = place[window]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(window) != 1)]))
    first, last = window[cut], window[np.append(cut[1:], len(window)) - 1]
    place = place[cut]
    context = _string_hashes(total, first, last + length) ^ mix(((place - first) << 20 | (last - first)).astype(np.uint64))
    return rows[first], first, last, place, grams[place], context


def _segments(offsets: np.ndarray, data: np.ndarray, length: int):
    """Pieces, with long rows cut into overlapping parts: first row, where the part begins in its row, offsets, bytes."""
    for row, at, part in pieces(offsets, data, SEGMENT):
        if len(part) <= SEGMENT:
            yield row, 0, at, part
        else:
            for a in range(0, len(part) - length + 1, SEGMENT):
                cut = part[a : a + SEGMENT + length - 1]
                yield row, a, np.array([0, len(cut)]), cut


def _row_names(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(0).cast(pa.int64()))


def all_samples(docs: DataFrame, length: int) -> DataFrame:
    """(row, more, first, span, name, context) of every sample of (row, text, more)."""

    def run(batches):
        for batch in batches:
            ids, more = _row_names(batch), batch.column(2)
            offsets, data = utf8(batch.column(1))
            for row, shift, at, part in _segments(offsets, data, length):
                rows, first, last, place, name, context = samples(at, part, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + rows]), more.take(pa.array(row + rows)), pa.array(first - at[rows] + shift), pa.array((last - first).astype(np.int16)), pa.array(name.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["row", "more", "first", "span", "name", "context"],
                )

    return docs.mapInArrow(run, "row long, more int, first long, span short, name long, context long")


def _identity(name: np.ndarray, context: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = mix(name.astype(np.uint64, copy=False) ^ mix(context.astype(np.uint64, copy=False)))
    return mix(x + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + first.astype(np.uint64))


def _identities(batch: pa.RecordBatch) -> np.ndarray:
    name, context, row, first = (np.asarray(batch.column(k)) for k in range(4))
    return _identity(name.view(np.uint64), context.view(np.uint64), row, first)


CONTEXT = "name long, context long, at short, span short, text binary"


def contexts(docs: DataFrame, wanted, length: int) -> DataFrame:
    """(name, context, at, span, text) of the samples in the filter; at: the sample's place in the context."""

    def run(batches):
        segments, bits = wanted.value
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            ids = _row_names(batch)
            offsets, data = utf8(batch.column(1))
            for row, shift, at, part in _segments(offsets, data, length):
                rows, first, last, place, name, context = samples(at, part, length)
                hit = np.flatnonzero(_bloom.known(_identity(name, context, ids[row + rows], first - at[rows] + shift), segments, table))
                raw = part.tobytes()
                texts = [raw[a : b + length] for a, b in zip(first[hit].tolist(), last[hit].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(name[hit].view(np.int64)), pa.array(context[hit].view(np.int64)), *(pa.array(x[hit].astype(np.int16)) for x in (place - first, last - first)), pa.array(texts, pa.binary())], names=["name", "context", "at", "span", "text"])

    return docs.mapInArrow(run, CONTEXT)


def _halves(texts: list[bytes], at: np.ndarray, span: np.ndarray, low: np.ndarray, high: np.ndarray, length: int):
    """The halves of each context's windows by their distance from the sample, which is in [low, high).

    Of each half: number of the context, first window, last window, low, high,
    name (of the string that all windows of the half hold), whole (of all that
    its windows span).
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    total = _prefix_hashes(data)
    sizes = np.array(list(map(len, texts)), np.int64)
    base = np.cumsum(sizes) - sizes
    middle = (low + high) // 2
    out = []
    for a, b in ((low, middle), (middle, high)):
        # window w of a context lies at - w before the sample
        first, last = np.maximum(0, at - b + 1), np.minimum(span, at - a)
        k = np.flatnonzero(first <= last)
        inner = _string_hashes(total, base[k] + at[k] - a[k], base[k] + at[k] - b[k] + 1 + length)
        whole = _string_hashes(total, base[k] + first[k], base[k] + last[k] + length) ^ mix(((at - first)[k] << 20 | (last - first)[k]).astype(np.uint64))
        out.append((k, first[k], last[k], a[k], b[k], inner ^ mix((a[k] << 20 | b[k]).astype(np.uint64)), whole))
    return [np.concatenate(x) for x in zip(*out)]


_HALF = "name long, whole long, own long, context long, n long, shift int, low int, high int, at short, span short, text binary"


def _halved(large: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                own, context, n, shift, low, high, at, span = (np.asarray(b.column(c)).astype(np.int64) for c in range(8))
                texts = b.column(8).to_pylist()
                which, first, last, a, z, name, whole = _halves(texts, at, span, low, high, length)
                cut = [texts[i][x : y + length] for i, x, y in zip(which.tolist(), first.tolist(), last.tolist())]
                columns = [pa.array((name ^ mix(own[which].view(np.uint64))).view(np.int64)), pa.array(whole.view(np.int64)), pa.array(own[which]), pa.array(context[which]), pa.array(n[which])]
                columns += [pa.array(x.astype(np.int32)) for x in (shift[which] + first, a, z)] + [pa.array(x.astype(np.int16)) for x in (at[which] - first, last - first)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names=["name", "whole", "own", "context", "n", "shift", "low", "high", "at", "span", "text"])

    return large.select("own", "context", "n", "shift", "low", "high", "at", "span", "text").mapInArrow(run, _HALF)


def bounded_names(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Recursion on names: contexts (name, own, context, shift, span, text) in names that one sort takes, and runs found on the way.

    found: (own, context, n, at, span, text) of names ``own`` with more.  The
    rounds number at most the logarithm of the windows of a context; each is
    written, so a lost executor costs one round.
    """
    large = found.select("own", "context", "n", F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(length - SAMPLE + 1).alias("high"), "at", "span", "text")
    small, runs = [], []
    for _ in range((length - SAMPLE).bit_length() + 1):
        halves = written(_halved(large, length), "halves")
        kinds = halves.groupBy("name", "whole").agg(F.sum("n").alias("all"), F.min(F.struct("own", "context")).alias("one"), (F.max("span") + F.lit(length)).cast("long").alias("bytes"))
        names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("bytes").alias("bytes"), F.sum("all").alias("total")).where("total > 1")
        live = written(kinds.join(names.drop("total").withColumnRenamed("bytes", "of_all"), "name"), "half-names")
        twice = live.where("all > 1").select("name", "whole")
        runs.append(halves.join(twice, ["name", "whole"]).select(F.col("own").alias("name"), "context", F.array(F.struct(F.col("shift").alias("a"), (F.col("shift") + F.col("span")).alias("b"))).alias("runs")))
        # one of each kind goes on; which one doesn't matter where there are two
        kept = live.where("kinds > 1").select("name", "whole", "of_all", F.col("one.own").alias("own"), F.col("one.context").alias("context"), F.col("all"))
        kept = written(halves.drop("n").join(kept, ["name", "whole", "own", "context"]), "half-contexts")
        small.append(kept.where(F.col("of_all") <= SORTED).select("name", "own", "context", "shift", "span", "text"))
        large = kept.where(F.col("of_all") > SORTED).select("own", "context", F.col("all").alias("n"), "shift", "low", "high", "at", "span", "text")
        if large.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(small), union(runs)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _repeats_sorted(group: list[tuple], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur again in the group, by sorting all suffixes."""
    raw = b"".join(x[3] for x in group)
    data = np.frombuffer(raw, np.uint8)
    total = _prefix_hashes(data)
    sizes = np.array([len(x[3]) for x in group])
    base = np.cumsum(sizes) - sizes
    counts = np.array([x[2] + 1 for x in group])
    window = np.zeros(len(data), bool)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(base, counts) + inner
    window[starts] = True
    order = suffix_array(data)
    order = order[window[order]]
    prefix = _string_hashes(total, order, order + length)
    same = prefix[1:] == prefix[:-1]
    again = np.zeros(len(data), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.split(again[starts], np.cumsum(counts)[:-1])


def _repeats_spooled(group, length: int):
    """The same by hashes of all windows, kept on disk: what tests hold the sort against."""
    with tempfile.TemporaryFile() as spool:
        heads, ends = [], [0]
        for name, context, span, text in group:
            spool.write(text)
            heads.append((name, context, span))
            ends.append(ends[-1] + len(text))
        flags = tempfile.TemporaryFile()
        counts = np.array([h[2] + 1 for h in heads])
        width = int(counts.max())
        seen = np.memmap(flags, np.uint8, "w+", shape=(len(heads), width))
        # windows are compared by their distance from the end of the context's last window: contexts of one
        # name end at different windows, so the hash itself must group them; offsets go in blocks
        step = max(1, (1 << 22) // len(heads))
        hashes = np.memmap(tempfile.TemporaryFile(), np.uint64, "w+", shape=(len(heads), width))
        for k in range(len(heads)):
            spool.seek(ends[k])
            data = np.frombuffer(spool.read(ends[k + 1] - ends[k]), np.uint8)
            at = np.arange(counts[k])
            hashes[k, : counts[k]] = _string_hashes(_prefix_hashes(data), at, at + length)
        parts = 1 + int(counts.sum()) // (1 << 22)
        for part in range(parts):
            rows, columns, values = [], [], []
            for k in range(0, len(heads), step * 64):
                block = np.asarray(hashes[k : k + step * 64])
                inside = (np.arange(width) < counts[k : k + step * 64, None]) & (block % U64(parts) == part)
                r, c = np.nonzero(inside)
                rows.append(r + k)
                columns.append(c)
                values.append(block[r, c])
            r, c, v = map(np.concatenate, (rows, columns, values))
            order = np.argsort(v, kind="stable")
            same = v[order][1:] == v[order][:-1]
            hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            seen[r[hit], c[hit]] = 1
        for k, head in enumerate(heads):
            yield head, np.asarray(seen[k, : counts[k]]).astype(bool)


_RUNS = "name long, context long, runs array<struct<a:int,b:int>>"


def repeated_windows(found: DataFrame, length: int) -> DataFrame:
    """(name, context, runs): first and last offset of each run of repeated windows of a context.

    found: (name, own, context, shift, span, text), by names of bounded size;
    own: the name of the result.
    """

    def run(batches):
        done, held, size, group, group_size, name = [], [], 0, [], 0, None

        def flush():
            for head, again in zip(held, _repeats_sorted(held, length)):
                if again.any():
                    done.append((head[0], head[1], [(a + head[4], b + head[4]) for a, b in _runs(again)]))
            held.clear()

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x[2]] for x in done], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["name", "context", "runs"])
            done.clear()
            return out

        def close():
            nonlocal size
            if len(group) > 1:  # whole names are sorted together
                if size + group_size > SORTED:
                    flush()
                    size = 0
                held.extend(group)
                size += group_size

        for b in batches:
            for key, own, context, shift, span, text in zip(*(b.column(k).to_pylist() for k in range(6))):
                if key != name:
                    close()
                    name, group, group_size = key, [], 0
                elif (own, context, shift) == (group[-1][0], group[-1][1], group[-1][4]):
                    continue  # equal rows give one context more than once
                group.append((own, context, span, text, shift))
                group_size += len(text)
                if len(done) >= 5000:
                    yield batch_of()
        close()
        if held:
            flush()
        if done:
            yield batch_of()

    rows = found.select("name", "own", "context", "shift", "span", "text")
    return rows.repartition("name").sortWithinPartitions("name", "context", "shift").mapInArrow(run, _RUNS)


def _cuts(part: np.ndarray, most: int):
    """Where to cut a long run of bytes: at white space, about every ``most`` bytes."""
    begin = 0
    while len(part) - begin > most:
        step = most
        while begin + step < len(part) and not (space := np.flatnonzero(SPACE[part[begin + step // 2 : begin + step]])).size:
            step *= 2
        if begin + step >= len(part):
            break
        end = begin + step // 2 + int(space[-1])
        yield begin, end
        begin = end
    yield begin, len(part)


_SHARED = "string long, c int, row long, more int"


def _sampled(batch: pa.RecordBatch, words_long: int, most: int):
    """Row numbers and hashes of the sampled strings of a batch of (row, more, text)."""
    width = words_long - SHINGLE + 1
    offsets, data = utf8(batch.column(2))
    for row, at, part in pieces(offsets, data, most):
        held, done = np.zeros(0, np.uint64), 0
        for begin, end in _cuts(part, most):
            # a long row goes on with the words that its next windows still hold
            _, rows, h = words(at if len(at) > 2 else np.array([0, end - begin]), part[begin:end])
            rows, h = np.concatenate([np.zeros(len(held), np.int64), rows]), np.concatenate([held, h])
            n = len(h)
            if n < words_long:
                held = h
                continue
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(h * POWERS(n), out=total[1:])
            first = np.arange(n - SHINGLE + 1)
            strings = _string_hashes(total, first, first + SHINGLE)
            lowest = np.lib.stride_tricks.sliding_window_view(strings, width).argmin(axis=1) + np.arange(n - words_long + 1)
            lowest = np.unique(lowest[rows[: n - words_long + 1] == rows[words_long - 1 :]])
            lowest = lowest[lowest >= done]
            yield row + rows[lowest], strings[lowest]
            held = h[n - words_long + 1 :]
            done = max(0, (int(lowest[-1]) + 1 if len(lowest) else done) - (n - words_long + 1))


def _rows_of(string, c, row, more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(string.view(np.int64)), pa.array(c, pa.int32()), pa.array(row), pa.array(more)], names=["string", "c", "row", "more"])


def shared_strings(docs: DataFrame, words_long: int) -> DataFrame:
    """(row, more, n_shared): how many sampled strings of 32 words of a document another one holds too.

    Of each ``words_long`` words the string with the smallest hash is sampled,
    so a passage of that many words which two documents share always gives one.
    A batch counts the strings that two of its own documents hold, and sends
    each string once, so a string that all documents hold isn't a hot key.
    Documents with one id and one text are one document; their counts add up.
    """

    def local(batches):
        for batch in batches:
            parts = list(_sampled(batch, words_long, SEGMENT))
            if not parts:
                continue
            index, string = map(np.concatenate, zip(*parts))
            row, more = np.asarray(batch.column(0))[index], np.asarray(batch.column(1))[index]
            order = np.lexsort((row, string))
            string, row, more = string[order], row[order], more[order]
            fresh = np.append(True, (string[1:] != string[:-1]) | (row[1:] != row[:-1]))[: len(string)]
            string, row, more = string[fresh], row[fresh], more[fresh]
            begin = np.flatnonzero(np.append(True, string[1:] != string[:-1])[: len(string)])
            size = np.diff(np.append(begin, len(string)))
            here = np.repeat(size > 1, size)
            yield _rows_of(string[~here], np.zeros((~here).sum(), np.int32), row[~here], more[~here])
            known = string[begin[size > 1]]
            yield _rows_of(known, np.full(len(known), -1), np.zeros(len(known), np.int64), np.zeros(len(known), np.int32))
            own, at, count = np.unique(row[here], return_index=True, return_counts=True)
            yield _rows_of(own, count, own, more[here][at])

    def across(batches):
        # a string that more may follow of: known to be shared (c -1), or its one document so far (c 0)
        held = _rows_of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            string, c, row, more = (np.concatenate([np.asarray(x.column(k)) for x in (held, batch)]) for k in range(4))
            counted = c > 0
            yield _rows_of(string[counted], c[counted], row[counted], more[counted])
            string, c, row, more = (x[~counted] for x in (string, c, row, more))
            if not len(string):
                held = held.slice(0, 0)
                continue
            fresh = np.append(True, (string[1:] != string[:-1]) | (c[1:] != c[:-1]) | (row[1:] != row[:-1]))
            string, c, row, more = (x[fresh] for x in (string, c, row, more))
            begin = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
            size = np.diff(np.append(begin, len(string)))
            shared = (size > 1) | (c[begin] < 0)
            out = np.repeat(shared, size) & (c == 0)
            yield _rows_of(string[out], np.ones(out.sum(), np.int32), row[out], more[out])
            held = _rows_of(string[-1:], np.array([-1 if shared[-1] else 0]), row[-1:], more[-1:])

    sent = docs.select("row", "more", "text").mapInArrow(local, _SHARED).repartition("string").sortWithinPartitions("string", "c", "row")
    return sent.mapInArrow(across, _SHARED).groupBy("row", "more").agg(F.sum("c").alias("n_shared"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, shared_words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (bytes; with ``digest``: kept_sha256) of every row.

    With ``shared_words`` also n_shared, see shared_strings: it tells of shared
    passages of that many words even where they are shorter than ``length``.
    """
    if length <= SAMPLE:
        raise ValueError(f"length must be over {SAMPLE}")
    if shared_words is not None and shared_words < SHINGLE:
        raise ValueError(f"shared_words must be {SHINGLE} or more")
    spark = docs.sparkSession
    # ids may be missing or shared: a row's name is made of id and text
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.xxhash64("id", "text").alias("row"), F.hash("text", "id").alias("more"), "text", "id")
    table = written(all_samples(named.select("row", "text", "more"), length), "samples")
    kinds = table.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("rep"), (F.max("span") + F.lit(length)).cast("long").alias("bytes"))
    kinds = written(kinds, "contexts")
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum("bytes").alias("of_all")).where("total > 1")
    live = written(kinds.drop("bytes").join(names, "name"), "repeated-names")
    mixed = live.where("kinds > 1")
    wanted = spark.sparkContext.broadcast(_bloom.build(mixed.select("name", "context", "rep.row", "rep.first"), _identities, mixed.count()))
    held = contexts(named.select("row", "text"), wanted, length)
    large = mixed.where(F.col("of_all") > SORTED).select("name", "context", "n")
    own = lambda rows: rows.select("name", F.col("name").alias("own"), "context", F.lit(0).alias("shift"), "span", "text")
    if large.isEmpty():
        found = repeated_windows(own(held), length)
    else:
        held = written(held, "held-contexts")
        hot = held.join(large, ["name", "context"]).withColumnRenamed("name", "own").dropDuplicates(["own", "context"])
        small, runs = bounded_names(hot, length)
        found = repeated_windows(own(held.join(large.select("name").distinct(), "name", "left_anti")).union(small), length).union(runs)
    whole = live.where("n > 1").select("name", "context", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"), F.lit(True).alias("all"))
    part = found.select("name", "context", "runs", F.lit(False).alias("all")).join(live.where("n > 1").select("name", "context"), ["name", "context"], "left_anti")
    windows = table.join(whole.union(part), ["name", "context"])
    last = F.col("first") + F.col("span")
    runs = F.when(F.col("all"), F.array(F.struct(F.col("first").alias("a"), last.alias("b")))).otherwise(F.transform("runs", lambda x: F.struct((F.col("first") + x["a"]).alias("a"), (F.col("first") + x["b"]).alias("b"))))
    by_row = windows.select("row", "more", runs.alias("runs")).groupBy("row", "more").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    kind, tail = docs.schema[id_col].dataType, "kept_sha256" if digest else "kept"

    def cut(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            sizes, removed, spans, kept = [], [], [], []
            lists = batch.column(2)
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text, runs = data[a:b], lists[k]
                sizes.append(b - a)
                if runs.is_valid and len(runs.values):
                    begin, end = (np.asarray(runs.values.field(x)).astype(np.int64) for x in "ab")
                    marks = np.zeros(b - a + 1, np.int64)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, end + length, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(len(_runs(gone)))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(hashlib.sha256(text.tobytes()).hexdigest() if digest else text.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.string() if digest else pa.binary()), *batch.columns[3:]], names=[id_col, "n_bytes", "n_removed", "n_spans", tail, "n_shared"][: 5 + batch.num_columns - 3])

    joined, more = named.join(by_row, ["row", "more"], "left"), []
    if shared_words is not None:
        joined, more = joined.join(shared_strings(named, shared_words), ["row", "more"], "left"), [F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared")]
    return joined.select("id", "text", "runs", *more).mapInArrow(cut, f"{id_col} {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, {tail} {'string' if digest else 'binary'}{', n_shared long' if more else ''}")
