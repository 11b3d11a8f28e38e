"""MinHash near-dedup with odd sketches.

A document is the set of its distinct word shingles.  Two documents are linked
if 100 * intersection >= percent * union; components of links are the groups.

1. Documents with equal sets form a class; one of them stands for it.
2. 128 MinHash samples are cut into 32 bands of 4.  At a likeness of 0.8 a link
   shares no band with a probability of 5e-8.
3. The samples are also folded into an odd sketch: a bitmap of the parity of
   the samples that fall on each bit.  The population count of two sketches'
   XOR shows how many samples differ; pairs that lie seven standard deviations
   beyond the threshold are put aside.
4. Candidates of a band are not all its pairs.  In three rounds every member
   is compared with one leader of its buckets, the one with which it shares most
   bands (leaders: the smallest id of a bucket; the member with most links; a
   random one), and what is connected is skipped.  Then members of buckets that
   are still apart are compared with all others of another component: in
   buckets of up to ``small`` members by pairs, in larger ones by blocks, where
   those outside of the bucket's largest component meet a block of its members
   in one task, and only links leave it.
5. Candidates are confirmed on the full sets, made again from the whole texts.

Rows: null texts count as empty, and documents without words have an empty
set, no links and themselves as component; rows without an id have no links, a
null component, and are kept; rows that share an id and differ in text are
documents that carry one id; an empty table gives no rows; columns other than
id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._bytes import U64, mix, pieces, shingles, utf8, words
from trustloom.llm._shared import parallelism, written
from trustloom.llm._worker import lean
from trustloom.llm.components import components

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS

_rng = np.random.default_rng(2014)
_SCALE = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_ORDER = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def sample_minima(values: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    low = (values >> U64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(out, (low[k : k + 256, None] * _SCALE + _SHIFT).min(axis=0), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    parts = minima.astype(np.uint64).reshape(BANDS, ROWS)
    key = mix(np.arange(BANDS, dtype=np.uint64) + U64(77))
    for k in range(ROWS):
        key = mix(key ^ parts[:, k])
    return key.view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parities of the samples by bit, as 64-bit words."""
    spots = (mix(minima.astype(np.uint64) ^ _ORDER) % U64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(spots, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def sketch_similarity(distance: float) -> float:
    """The likeness that a population count of two sketches' XOR stands for."""
    free = 1 - 2 * min(distance, SKETCH_BITS / 2 - 1) / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(free)


def sketch_limit(similarity: float, sigmas: float = 7) -> int:
    """The largest population count that two sets of this likeness can be expected to show."""
    differ = min(SAMPLES, SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity)))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return math.ceil(mean + sigmas * math.sqrt(SKETCH_BITS) / 8)


def _sets(offsets: np.ndarray, data: np.ndarray, width: int):
    """The sorted distinct shingles of each row of a piece."""
    _, rows, hashes = words(offsets, data)
    found, bounds = shingles(rows, hashes, len(offsets) - 1, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(found[a:b])


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), whole (digest of the set), bands array<long>, sketch array<long>."""

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for row, at, part in pieces(offsets, data):
                n, whole, bands, sketches = [], [], [], []
                for values in _sets(at, part, width):
                    n.append(len(values))
                    if len(values):
                        minima = sample_minima(values)
                        whole.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(minima))
                        sketches.append(odd_sketch(minima))
                    else:
                        whole.append(None)
                        bands.append(np.zeros(0, np.int64))
                        sketches.append(np.zeros(0, np.int64))
                arrays = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in y])]).astype(np.int32), np.concatenate(y)) for y in (bands, sketches)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), *arrays], names=["id", "n", "whole", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "id long, n long, whole binary, bands array<long>, sketch array<long>")


def _near(left: str, right: str, limit: int):
    parts = [F.bit_count(F.col(f"{left}.sketch")[k].bitwiseXOR(F.col(f"{right}.sketch")[k])) for k in range(SKETCH_WORDS)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return total <= limit


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the ids, once for each text that an id has, however often its row is repeated.

    At scale both sides shuffle, and so they do here at any size: plans that
    change with the size would be measured in one form and run in another.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(texts.join(ids.distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets.

    Texts (id, text), not sets, travel: they are smaller.  Both joins deal them
    by id in the same way, so the one shuffle of them serves twice.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                a, b = (np.asarray(part.column(x)) for x in range(2))
                ids, first = np.unique(np.concatenate([a, b]), return_index=True)
                texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
                sets: list[np.ndarray] = []
                offsets, data = utf8(texts)
                for _, at, piece in pieces(offsets, data):
                    sets += _sets(at, piece, width)
                left, right = np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist()
                found = np.array([_linked(sets[x], sets[y], percent) for x, y in zip(left, right)], bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lean(run), "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


BLOCK = 256


def _links_in_cell(key: int, left: list[tuple], right: list[tuple], percent: int, limit: int) -> list[tuple[int, int]]:
    """Links between two blocks of a bucket; rows are (rep, component, bands, sketch, set), left ones are outside its main component."""
    ids = [np.array([x[0] for x in side]) for side in (left, right)]
    groups = [np.array([x[1] for x in side]) for side in (left, right)]
    bands = [np.stack([x[2] for x in side]) for side in (left, right)]
    main = {x[0] for x in left}
    twice = np.array([x in main for x in ids[1].tolist()])
    # a pair is looked at in the first bucket that it shares, and once where both are outside
    shares = bands[0][:, None, :] == bands[1][None, :, :]
    first = bands[0][np.arange(len(left))[:, None], shares.argmax(axis=2)] == key
    open_ = first & (groups[0][:, None] != groups[1][None, :]) & ~(twice[None, :] & (ids[0][:, None] >= ids[1][None, :]))
    if not open_.any():
        return []
    sketches = [np.stack([x[3] for x in side]) for side in (left, right)]
    apart = np.bitwise_count(sketches[0][:, None, :] ^ sketches[1][None, :, :]).sum(axis=2, dtype=np.int64)
    rows, columns = np.nonzero(open_ & (apart <= limit))
    order = np.argsort(apart[rows, columns], kind="stable")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for r, c in zip(rows[order].tolist(), columns[order].tolist()):
        a, b = root(int(groups[0][r])), root(int(groups[1][c]))
        if a != b and _linked(left[r][4], right[c][4], percent):
            parent[a] = b
            out.append((int(ids[0][r]), int(ids[1][c])))
    return out


def _links_by_blocks(rest: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside large buckets: rest has (key, rep, component, size)."""
    share = rest.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("all"))
    share = share.select("key", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("all") / BLOCK).cast("int").alias("inner"))
    rows = rest.select("key", "rep", "component").join(share, "key")
    spread = F.xxhash64("rep")
    left = rows.where("component <> main").select("key", "rep", "component", F.lit(0).alias("side"), F.pmod(spread, "outer").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("y"))
    right = rows.select("key", "rep", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"), F.pmod(spread, "inner").cast("int").alias("y"))

    def sets(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(3))
            for row, at, part in pieces(offsets, data):
                found = list(_sets(at, part, width))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, len(found)) for k in range(3)), pa.array([x.tobytes() for x in found], pa.binary())], names=["rep", "bands", "sketch", "shingles"])

    wanted = reps.join(rest.select("rep").distinct(), "rep", "left_semi")
    full = wanted.join(texts.withColumnRenamed("id", "rep"), "rep").select("rep", "bands", "sketch", "text")
    full = written(full.mapInArrow(lean(sets), "rep long, bands array<long>, sketch array<long>, shingles binary"), "sets")
    limit = sketch_limit(percent / 100)

    def run(batches):
        held, sides = None, ([], [])
        for batch in batches:
            for key, x, y, side, rep, component, bands, sketch, shingles_ in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (key, x, y) != held:
                    if held and sides[0] and sides[1]:
                        yield found_in(held[0], sides)
                    held, sides = (key, x, y), ([], [])
                sides[side].append((rep, component, np.array(bands), np.array(sketch).view(np.uint64), np.frombuffer(shingles_, np.uint64)))
        if held and sides[0] and sides[1]:
            yield found_in(held[0], sides)

    def found_in(key, sides):
        found = _links_in_cell(key, sides[0], sides[1], percent, limit)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

    cells = left.union(right).join(full, "rep").select("key", "x", "y", "side", "rep", "component", "bands", "sketch", "shingles")
    return cells.repartition(parallelism(rest.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(run), "a long, b long")


def _with_component(entries: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return entries.withColumn("component", F.col("rep"))
    return entries.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _apart(entries: DataFrame, leader) -> DataFrame:
    """Entries of the buckets whose members aren't all connected, with the bucket's leader and size."""
    of = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), leader.alias("leader")).where("low < high").drop("low", "high")
    return entries.join(of, "key")


def linked_groups(docs: DataFrame, sigs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text", small: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(whole, rep) of each class, and (node, component) of the representatives that have links."""
    limit = sketch_limit(percent / 100)
    # bands and sketch follow from the set, so any row of a class has them
    held = sigs.where("n > 0 AND id IS NOT NULL").groupBy("whole").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    held = written(held, "classes")
    classes, reps = held.select("whole", "rep"), held.select("rep", "bands", "sketch")
    entries = reps.select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    entries = written(entries.join(shared, "key"), "bands")
    # the corpus is dealt by id once; only texts of documents that share a bucket are joined later
    texts = texts_of(entries.select(F.col("rep").alias("id")), docs, id_col, text_col)
    sketches = reps.select("rep", "sketch")
    links, tested, groups = None, None, None

    def joined(found: DataFrame) -> None:
        nonlocal links, groups
        links = found if links is None else links.union(found)
        edges = found if groups is None else found.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        groups = components(edges)

    def compare(pairs: DataFrame) -> None:
        nonlocal tested
        pairs = pairs.select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        near = pairs.alias("p").join(sketches.alias("x"), F.col("p.a") == F.col("x.rep")).join(sketches.alias("y"), (F.col("p.b") == F.col("y.rep")) & _near("x", "y", limit))
        near = written(near.select("p.a", "p.b").distinct(), "candidates")
        if near.isEmpty():
            return
        tested = near if tested is None else tested.union(near)
        joined(written(confirmed(near, texts, width, percent), "confirmed"))

    # leaders: the smallest id, then the member with most links, then a random one
    for turn in range(3):
        now = _with_component(entries, groups)
        if turn == 1 and links is not None:
            degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
            now = now.join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
            leader = F.max(F.struct("degree", "rep"))["rep"]
        elif turn == 2:
            leader = F.min(F.struct(F.xxhash64("rep"), "rep"))["rep"]
        else:
            leader = F.min("rep")
        rows = _apart(now, leader).where("leader <> rep")
        if groups is not None:
            of = groups.select(F.col("node").alias("leader"), F.col("component").alias("its"))
            rows = rows.join(of, "leader", "left").where("component <> coalesce(its, leader)")
        nearest = rows.groupBy("rep", "leader").agg(F.count("*").alias("bands")).groupBy("rep").agg(F.max(F.struct("bands", "leader"))["leader"].alias("leader"))
        compare(nearest.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")))

    rest = written(_apart(_with_component(entries, groups), F.min("rep")).select("key", "rep", "component", "size"), "apart")
    large = rest.where(F.col("size") > small)
    if not large.isEmpty():
        joined(written(_links_by_blocks(large, reps, texts, width, percent), "block-links"))
    cells = rest.where(F.col("size") <= small).drop("component", "size").join(sketches, "rep")
    cells = _with_component(cells, groups)
    x, y = cells.alias("x"), cells.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _near("x", "y", limit))
    compare(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
    return classes, groups


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: of every row, with the smallest id of its group."""
    sigs = written(signatures(docs, width, id_col, text_col), "signatures")
    classes, groups = linked_groups(docs, sigs, width, percent, id_col, text_col)
    if groups is not None:
        classes = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.select("whole", F.col("rep").alias("component"))
    # a row without an id may share its set with others, but has no links
    rows = sigs.select("id", "n", F.when(F.col("id").isNotNull(), F.col("whole")).alias("whole"))
    component = F.coalesce("component", "id")
    return rows.join(classes, "whole", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL for the rows of op4.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w
), n AS (
  SELECT w.doc_id, count(s.g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
)
SELECT n.doc_id, n.n AS n_shingles, min(r.seen) AS component_id, n.doc_id = min(r.seen) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
