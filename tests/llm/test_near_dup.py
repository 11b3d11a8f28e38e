import random

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from trustloom.llm import near_dup
from trustloom.llm.components import components


def shingle_set(text, width):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(texts, ids, width, percent=80):
    sets = [shingle_set(t, width) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and ids[a] is not None and ids[b] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[x] = y
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, i in enumerate(ids):
        c = least[root(k)] if i is not None else None
        out.append((i, len(sets[k]), c, i is None or i == c))
    return sorted(out, key=repr)


def edited(rnd, words, share):
    words = list(words)
    for k in range(len(words)):
        if rnd.random() < share:
            words[k] = f"e{rnd.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(11)
    bases = [[f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([6, 30, 120, 400]))] for _ in range(25)]
    texts = [edited(rnd, b, rnd.choice([0, 0.005, 0.02, 0.04, 0.08])) for b in bases for _ in range(8)]
    texts += [t.upper().replace(" ", "\n ") for t in texts[:10]] + ["a b c", "A  b\tc", "a b", "a b c d", "a b c d e"] + ODD
    ids = [3 * k for k in range(len(texts))]
    rnd.shuffle(ids)
    ids[2] = None
    return texts, ids


def run(spark, texts, ids, width=4, **kw):
    return sorted((tuple(r) for r in near_dup.near_duplicates(docs(spark, texts, ids), width=width, **kw).collect()), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(spark, table, width):
    assert run(spark, *table, width=width) == brute(*table, width)


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    texts = [edited(rnd, base, rnd.choice([0.01, 0.03, 0.05])) for _ in range(160)]
    ids = list(range(160))
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    real = near_dup.linked_groups
    monkeypatch.setattr(near_dup, "linked_groups", lambda *a, **k: real(*a, **k, small=4))
    assert run(spark, texts, ids) == brute(texts, ids, 4)


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for similarity in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            extra = round(2000 * (1 - similarity) / (2 * similarity))
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, extra, dtype=np.uint64)])) for _ in range(2))
            x, y = (near_dup.odd_sketch(near_dup.sample_minima(s)) for s in (a, b))
            distance = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64).tolist())
            assert distance <= near_dup.sketch_limit(0.8)
            errors.append(near_dup.sketch_similarity(distance) - similarity)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in got} and set(got) >= {x for e in edges for x in e if e[0] != e[1]}


def test_no_rows_and_no_links(spark):
    assert run(spark, [], []) == []
    assert run(spark, ["one two three four five", "six seven eight nine ten", None], [1, 2, 3]) == [(1, 2, 1, True), (2, 2, 2, True), (3, 0, 3, True)]
