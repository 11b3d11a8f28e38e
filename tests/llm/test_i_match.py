import random

import pytest

from tests.llm.helpers import ODD, docs, sha
from trustloom.llm import i_match


def babble(rnd, n):
    return " ".join(rnd.choice(["alpha", "Beta,", "é", "zz"]) if rnd.random() < 0.3 else f"w{rnd.randint(0, 900)}." for _ in range(n))


def brute(texts, ids):
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, -(ids[k] or 0), texts[k] or ""))
    plain = [t or "" for t in texts]
    counts = {}
    for t in plain:
        for w in i_match.terms(t.encode()):
            counts[w] = counts.get(w, 0) + 1
    import math

    n = len(texts)
    low = max(2, math.ceil(n * math.exp(-i_match.IDF_HIGH)))
    band = {w for w, c in counts.items() if low <= c <= max(low, n * math.exp(-i_match.IDF_LOW))}

    def print_of(t):
        own = i_match.terms(t.encode())
        return i_match.fingerprint((own & band) or own)

    out = []
    for at, k in enumerate(order):
        t, f = plain[k], plain[order[(at + 1) % n]]
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        x, y, z = map(print_of, (t, e, f))
        out.append((ids[k], len(t), sha(e), x, y, round(i_match.likeness(x, y), 9), round(i_match.likeness(x, z), 9)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(2)
    texts = [babble(rnd, rnd.choice([0, 1, 5, 60, 300, 900])) for _ in range(120)] + ODD
    ids = [7 * k - 100 for k in range(len(texts))]
    ids[4] = ids[3]
    ids[9] = ids[10] = None
    return texts, ids


def test_equals_brute_force(spark, table):
    assert rows(i_match.compare_edited(docs(spark, *table))) == brute(*table)


def test_large_lexicon_is_joined(spark, table, monkeypatch):
    monkeypatch.setattr(i_match, "MOST_BROADCAST", 0)
    assert rows(i_match.compare_edited(docs(spark, *table))) == brute(*table)


def test_halves_are_nearer_than_strangers(spark, table):
    found = [r for r in i_match.compare_edited(docs(spark, *table)).collect() if r.n_chars > 200]
    assert sum(r.near_edited for r in found) > 3 * sum(r.near_next for r in found)


def test_one_row_no_rows_and_fingerprints(spark):
    r = i_match.compare_edited(docs(spark, ["abc def ghi jkl"], [5])).first()
    assert (r.doc_id, r.edited_sha256, r.near_next) == (5, sha("abc def abc def"), 1.0)
    assert i_match.compare_edited(docs(spark, [])).count() == 0
    got = {r.doc_id: r.fingerprint for r in i_match.fingerprints(docs(spark, ["a b", "b a", "", None])).collect()}
    assert got[0] == got[1] != got[2] == got[3] == i_match.EMPTY * i_match.SUBSETS
