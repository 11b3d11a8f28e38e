"""Overlap of programs by their n-grams of tokens."""

from __future__ import annotations

from collections import Counter
from math import exp, log

#: Entries kept at most: a batch may hold thousands of long programs.
KEPT = 1000


def grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[k:] for k in range(n)])) if n > 1 else Counter(tokens)


def counted(text: str, n: int) -> tuple[int, list[Counter]]:
    """Number of tokens (parted by one space), and their 1- to n-grams."""
    tokens = text.split(" ") if text else []
    return len(tokens), [grams(tokens, k) for k in range(1, n + 1)]


def overlap(reference: str | None, candidate: str | None, n: int, keywords: tuple[str, ...], held: dict) -> tuple[float | None, float | None]:
    if not candidate:
        return 0.0, 0.0
    if reference is None:
        return None, None
    for text in (reference, candidate):
        if text not in held:
            held[text] = counted(text, n)
    (n_r, r), (n_c, c) = held[reference], held[candidate]
    hits = [sum([min(x, a[g]) for g, x in b.items() if g in a]) for a, b in zip(r, c)]
    made = [max(n_c - k, 0) for k in range(n)]
    plain = sum([log((h + 1) / (m + 1)) for h, m in zip(hits, made)])
    # keywords count four times more
    more = [(min(x, r[0][w]), x) for w in keywords if (x := c[0][w])]
    first = log((hits[0] + 4 * sum([x for x, _ in more]) + 1) / (made[0] + 4 * sum([x for _, x in more]) + 1))
    weighted = plain - log((hits[0] + 1) / (made[0] + 1)) + first
    short = 1.0 if n_c >= n_r else exp(1.0 - n_r / n_c)
    return exp(plain / n) * short, exp(weighted / n) * short


def overlaps(reference: str | None, candidate: str | None, n: int, keywords: tuple[str, ...], held: dict) -> tuple[float | None, float | None]:
    """Plain and keyword-weighted overlap of two texts of tokens.  held: the latest counts by text and overlaps by pair."""
    pair = (reference, candidate)
    if len(held) > KEPT:
        held.clear()
    if pair not in held:
        held[pair] = overlap(reference, candidate, n, keywords, held)
    return held[pair]
