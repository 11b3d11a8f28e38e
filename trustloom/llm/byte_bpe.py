"""Byte-level BPE: a lazily determinised transducer over the merges, and a streaming decoder.

The transducer reads a pre-token byte by byte.  Its state is the longest suffix
read that begins some token (a node of a trie with failure links) and, for each
start inside that suffix, the last token of the encoding of what lies before.
That is all that later bytes can ask of earlier ones: the encoding of a prefix
ends in the one token t that fits the last token u of the prefix before it, and
"t fits u" means that merging their joined bytes gives u and t again.  States
and transitions are made when first met.  A token is emitted as soon as every
start inside the suffix leads back through it, so the lookahead is bounded by
the longest token.

Rows: null texts count as empty, an empty text has no tokens; repeated rows
give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._bytes import pieces, utf8
from trustloom.llm._units import OTHER_SCRIPT, TokenPool, hashed_units
from trustloom.llm._worker import kept, lean

#: Fixed value: the pre-token pattern that the rank files go with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beyond ASCII: runs of it reach across chunks, so such texts go through PATTERN as a whole.
_WIDE_SPACE = regex.compile("[\x85\xa0  -     　]")
#: What the regex library counts as white space and the Unicode property doesn't, or the reverse, is settled by naming the property.
_PATTERN = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTransducer:
    """Encodes byte strings as merging by ascending rank would."""

    #: States are forgotten all at once beyond this many.
    MOST_STATES = 120_000
    #: Pairs of tokens whose fit is remembered.
    MOST_PAIRS = 300_000
    #: Bytes of one pre-token between looks at what can be emitted.
    STRIDE = 2048

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._trie()
        self._fits: dict[int, bool] = {}
        self._forget()

    def _trie(self) -> None:
        go: dict[int, int] = {}  # by node * 256 + byte
        depth, token = [0], [-1]
        for t, r in self.ranks.items():
            node = 0
            for b in t:
                child = go.get(node << 8 | b)
                if child is None:
                    child = go[node << 8 | b] = len(depth)
                    depth.append(depth[node] + 1)
                    token.append(-1)
                node = child
            token[node] = r
        fail, shorter = [0] * len(depth), [0] * len(depth)
        for edge, child in sorted(go.items(), key=lambda x: depth[x[1]]):
            node, b = edge >> 8, edge & 255
            if node:
                f = fail[node]
                while f and f << 8 | b not in go:
                    f = fail[f]
                fail[child] = go.get(f << 8 | b, 0)
            # the nearest node down the failure links that is a token
            f = fail[child]
            shorter[child] = f if token[f] >= 0 else shorter[f]
        self.go, self.depth, self.token, self.fail, self.shorter = go, depth, token, fail, shorter

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, int] = {}  # by state * 256 + byte
        self.last: list[int] = []
        self.start = self._state(0, (-1,))

    def _state(self, node: int, window: tuple) -> int:
        key = (node, window)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(window[-1])
        return s

    def _merged(self, text: bytes) -> list[int]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while True:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [self.ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def fits(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        pair = before << 32 | token
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) > self.MOST_PAIRS:
                self._fits.clear()
            found = self._fits[pair] = self._merged(self.text[before] + self.text[token]) == [before, token]
        return found

    def _move(self, state: int, byte: int) -> int:
        node, window = self.keys[state]
        while node and node << 8 | byte not in self.go:
            node = self.fail[node]
        node = self.go.get(node << 8 | byte, 0)
        t = node if self.token[node] >= 0 else self.shorter[node]
        while t:
            # window[-d] belongs to the prefix that ends d bytes before the new one
            if self.fits(window[-self.depth[t]], self.token[t]):
                break
            t = self.shorter[t]
        else:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        deep = self.depth[node]
        kept = window[len(window) - deep :] + (self.token[t],)
        new = self._state(node, kept)
        self.moves[state << 8 | byte] = new
        return new

    def encode(self, text: bytes) -> list[int]:
        if len(self.keys) > self.MOST_STATES:
            self._forget()
        out: list[int] = []
        ends: list[int] = []  # the last token of each prefix of what isn't emitted
        s, moves, last = self.start, self.moves, self.last
        for i, b in enumerate(text):
            n = moves.get(s << 8 | b)
            s = n if n is not None else self._move(s, b)
            ends.append(last[s])
            if len(ends) >= self.STRIDE and not i % 256:
                done = self._settled(ends, self.depth[self.keys[s][0]])
                out += self._back(ends, done)
                del ends[:done]
                if len(self.keys) > self.MOST_STATES:
                    key = self.keys[s]
                    self._forget()
                    s, moves, last = self._state(*key), self.moves, self.last
        return out + self._back(ends, len(ends))

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.text[ends[at - 1]])
        return out[::-1]

    def _settled(self, ends: list[int], deep: int) -> int:
        """The furthest boundary that the encodings of all prefixes inside the open suffix share."""
        live = {len(ends) - k for k in range(deep + 1)}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - len(self.text[ends[top - 1]]) if top > 0 else 0)
        return max(0, live.pop())


class Utf8Machine:
    """Incremental UTF-8: bytes in, text out; what may still become a character waits for its next bytes.

    States are the number of continuation bytes due and the range of the first
    of them; a byte outside of it replaces what waited by U+FFFD.
    """

    #: First byte to (continuation bytes, lowest and highest first continuation byte).
    _LEAD = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF4: (3, 0x80, 0x8F)}

    def __init__(self) -> None:
        self.waits = b""

    def feed(self, data: bytes) -> str:
        data = self.waits + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b in self._LEAD:
                due, low, high = self._LEAD[b]
                if due >= back and (back < 2 or low <= data[-back + 1] <= high):
                    cut = len(data) - back
                break
            if not 0x80 <= b < 0xC0:
                break
        self.waits = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waits = self.waits, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder of one vocabulary, with the caches of one worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = MergeTransducer(ranks)
        self.pool = TokenPool(self._encode_units, np.uint32 if max(ranks.values()) > 0xFFFF else np.uint16, most=300_000)
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.bytes = [self.transducer.text.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def _encode_units(self, units: list[bytes], kinds: list[int]) -> list[list[int]]:
        encode = self.transducer.encode
        return [encode(u) if k != OTHER_SCRIPT else self.encode_text(u.decode()) for u, k in zip(units, kinds)]

    def encode_text(self, text: str) -> list[int]:
        """By the pattern, match by match."""
        return [x for m in _PATTERN.findall(text) for x in self.transducer.encode(m.encode())]

    def encode_rows(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Row number and token ids, for all rows of a piece."""
        starts, lengths, kinds, hashes = hashed_units(offsets, data, True)
        ids, counts = self.pool.tokens(self.pool.lookup(data, starts, lengths, kinds, hashes))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        wide = _WIDE_SPACE.search(data.tobytes().decode()) is not None
        for k in range(len(offsets) - 1):
            if wide and _WIDE_SPACE.search(text := data[offsets[k] : offsets[k + 1]].tobytes().decode()):
                yield k, np.array(self.encode_text(text), self.pool.dtype)
            else:
                yield k, ids[ends[k] : ends[k + 1]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode_stream(self, ids, step: int = 4096) -> Iterator[str]:
        """Text as it becomes certain, for ids that arrive ``step`` at a time."""
        machine = Utf8Machine()
        for k in range(0, len(ids), step):
            yield machine.feed(self.decode(ids[k : k + step]))
        yield machine.close()


def _codec(broadcast) -> ByteBpe:
    name, ranks = broadcast.value
    return kept(f"byte-bpe {name}", lambda: ByteBpe(ranks))


def _shared_ranks(df: DataFrame, path: str):
    ranks = read_ranks(path)  # a vocabulary: its size doesn't grow with the data
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, ranks))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every text; in row order, nothing shuffles."""
    held, kind = _shared_ranks(df, path), df.schema[id_col].dataType

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for row, at, part in pieces(offsets, data):
                found = [x for _, x in codec.encode_rows(at, part)]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), ids], names=[id_col, "ids"])

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(run), f"{id_col} {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of each array of ids, by the streaming decoder."""
    held = _shared_ranks(df, path)

    @F.pandas_udf("string")
    def text(ids):
        codec = _codec(held)
        return ids.map(lambda x: "".join(codec.decode_stream(list(x))) if x is not None else None)

    return df.withColumn(text_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Digests of every text's ids and of the bytes that they decode to, in one pass without shuffles.

    id_col, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256; with_ids: and ids.
    """
    held, kind = _shared_ranks(df, path), df.schema[id_col].dataType

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for row, at, part in pieces(offsets, data):
                counts, ids_hex, decoded_hex, all_ids = [], [], [], []
                for _, ids in codec.encode_rows(at, part):
                    if with_ids:
                        all_ids.append(ids)
                    ids = ids.tolist()
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                    machine, digest = Utf8Machine(), hashlib.sha256()
                    for k in range(0, len(ids), 1 << 16):
                        digest.update(machine.feed(codec.decode(ids[k : k + (1 << 16)])).encode())
                    digest.update(machine.close().encode())
                    decoded_hex.append(digest.hexdigest())
                columns = [batch.column(0).slice(row, len(counts)), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(all_ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(run), f"{id_col} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")
