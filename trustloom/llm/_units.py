"""Texts as runs of bytes ("units") whose tokens don't depend on their neighbours, and a cache from units to tokens.

Both subword vocabularies here split a text by a pattern over letters, digits
and other characters before any merge.  Where a chunk between white space
holds nothing but ASCII and the letters U+00C0-U+00FF and U+0140-U+017F, and no
apostrophe, its letter, digit and other runs are exactly the matches of that
pattern, so they can be found on whole arrays of bytes.  Any other chunk stays
whole, as one unit of kind OTHER_SCRIPT, for the caller's own pattern.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from trustloom.llm._bytes import SPACE, gather, span_hashes

WHITE, LETTER, DIGIT, MARK, OTHER_SCRIPT = range(5)

_KIND = np.full(256, MARK, np.uint8)
_KIND[SPACE] = WHITE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[0x80:] = OTHER_SCRIPT
_KIND[0x80:0xC0] = LETTER  # continuation bytes go with what leads them
_KIND[[0xC3, 0xC5]] = LETTER
_KIND[0x27] = OTHER_SCRIPT


def split_units(offsets: np.ndarray, data: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and kinds of the units, which cover all bytes in order.

    spaced: a run takes the single space before it along, as in byte-level
    vocabularies; white space that is left before a run is cut from its last
    character, which stands alone.  Otherwise white space is a unit of kind WHITE.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint8)
    kind = _KIND[data]
    # the multiplication and division signs are no letters
    signs = np.flatnonzero(data[:-1] == 0xC3)
    signs = signs[(data[signs + 1] == 0x97) | (data[signs + 1] == 0xB7)]
    kind[signs] = OTHER_SCRIPT
    white = kind == WHITE
    fresh = np.zeros(n, bool)
    cut = offsets[:-1]
    fresh[cut[cut < n]] = True
    opens = ~white
    opens[1:] &= white[:-1] | fresh[1:]
    chunk = np.flatnonzero(opens)
    odd = np.flatnonzero(kind == OTHER_SCRIPT)
    if len(odd):
        which = np.unique(np.searchsorted(chunk, odd, "right") - 1)
        ends = np.flatnonzero(~white & np.append(white[1:] | fresh[1:], True)) + 1
        begin, length = chunk[which], ends[which] - chunk[which]
        kind[gather(np.arange(n), begin, length)] = OTHER_SCRIPT
    edge = fresh.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    if spaced:
        after = chunk[(chunk > 0) & ~fresh[chunk]]  # each has white space before it
        edge[after - 1] = True
        edge[after] = data[after - 1] != 0x20
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, n))
    # a unit's kind is that of its last byte: the first may be its space
    return starts, lengths, kind[starts + lengths - 1]


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def edges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each unit as numbers: with the length, all of a unit of up to 16 bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    size = np.minimum(lengths, 8)
    head, tail = (np.ascontiguousarray(words[at]).view("<u8")[:, 0] & _KEPT[size] for at in (starts, starts + lengths - size))
    return head, tail


class TokenPool:
    """Token ids of units seen before; forgotten all at once when ``most`` units are held.

    Units are looked up by hash and compared byte by byte, so of two units with
    one hash neither gets the other's ids.
    """

    SLOTS = 1 << 20

    def __init__(self, encode: Callable[[list[bytes], list[int]], list[list[int]]], dtype, most: int = 600_000):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.index: dict[int, int] = {}
        self.begin, self.length, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids, self.used = np.zeros(1 << 18, self.dtype), 0
        self.head, self.tail, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        self.long: dict[int, bytes] = {}

    def add(self, units: list[bytes], found: list[list[int]], head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        flat = np.fromiter((x for y in found for x in y), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(found) > len(self.begin):
            self.begin, self.length, self.head, self.tail, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.head, self.tail, self.size))
        new = np.arange(self.count, self.count + len(found))
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[new] = sizes
        self.begin[new] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), self.count + len(found)
        self.head[new], self.tail[new], self.size[new] = head, tail, list(map(len, units))
        self.long.update((k, u) for k, u in zip(new.tolist(), units) if len(u) > 16)
        return new

    def _encoded(self, where: np.ndarray, data, starts, lengths, kinds, head, tail) -> np.ndarray:
        units = [data[a : a + m].tobytes() for a, m in zip(starts[where].tolist(), lengths[where].tolist())]
        return self.add(units, self.encode(units, kinds[where].tolist()), head[where], tail[where])

    def _others(self, out: np.ndarray, data, starts, lengths, head, tail) -> np.ndarray:
        """Which units aren't the held ones that their hashes point to."""
        wrong = (self.size[out] != lengths) | (self.head[out] != head) | (self.tail[out] != tail)
        for k in np.flatnonzero((lengths > 16) & ~wrong).tolist():
            wrong[k] = self.long[int(out[k])] != data[starts[k] : starts[k] + lengths[k]].tobytes()
        return np.flatnonzero(wrong)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The index of each unit; its ids are ids[begin[i] : begin[i] + length[i]]."""
        if self.count > self.most:
            self.clear()
        head, tail = edges(data, starts, lengths)
        at = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.slot[at], -1).astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            distinct, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            got = np.fromiter(map(self.index.get, distinct.tolist(), _minus), np.int64, len(distinct))
            new = np.flatnonzero(got < 0)
            if len(new):
                got[new] = made = self._encoded(missing[first[new]], data, starts, lengths, kinds, head, tail)
                slots = (distinct[new] & np.uint64(self.SLOTS - 1)).astype(np.int64)
                free = self.slot[slots] < 0
                self.keys[slots[free]], self.slot[slots[free]] = distinct[new][free], made[free]
                # of two that took one slot the last one stands, with its own key; those without a slot are found by the index
                other = self.keys[slots] != distinct[new]
                self.index.update(zip(distinct[new][other].tolist(), made[other].tolist()))
            out[missing] = got[back]
        wrong = self._others(out, data, starts, lengths, head, tail)
        if len(wrong):
            out[wrong] = self._encoded(wrong, data, starts, lengths, kinds, head, tail)
        return out

    def tokens(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of units, and the number of each unit."""
        length = self.length[units]
        return gather(self.ids, self.begin[units], length), length


class _Minus:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_minus = _Minus()


def hashed_units(offsets: np.ndarray, data: np.ndarray, spaced: bool):
    """split_units, and a hash of each unit's bytes."""
    starts, lengths, kinds = split_units(offsets, data, spaced)
    return starts, lengths, kinds, span_hashes(data, starts, None)
