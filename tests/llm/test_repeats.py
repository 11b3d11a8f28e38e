import random

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs, sha
from trustloom.llm import repeats


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            h = b[i : i + length]
            seen[h] = seen.get(h, 0) + 1
    out = []
    for k, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), spans, sha(kept)))
    return out


def run(spark, texts, ids=None):
    return sorted(tuple(r) for r in repeats.remove_repeats(docs(spark, texts, ids), digest=True).collect())


def babble(rnd, n):
    return " ".join("".join(rnd.choices("abcdeéfgh", k=rnd.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 50, 301])
@pytest.mark.parametrize("symbols", [1, 2, 200])
def test_suffix_array(n, symbols):
    rnd = random.Random(n)
    text = np.array([rnd.randrange(symbols) for _ in range(n)], np.int64)
    assert repeats.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    passages = [babble(rnd, rnd.randint(40, 220)) for _ in range(12)]
    texts = []
    for k in range(90):
        parts = [babble(rnd, rnd.randint(0, 90)) for _ in range(rnd.randint(1, 4))]
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            a = rnd.randint(0, max(0, len(p) - 380))
            parts.insert(rnd.randint(0, len(parts)), p[a : a + rnd.choice([399, 400, 401, 700, 2000])])
        texts.append("".join(parts))
    copy = texts[3]
    for at in range(0, len(copy), 350):
        copy = copy[:at] + "#" + copy[at + 1 :]
    texts += [copy, texts[3], babble(rnd, 30) * 9, "x" * 400, "x" * 399, "y" * 401, "z" * 400, "z" * 400] + ODD[:7] + ["same row"] * 2
    assert run(spark, texts) == brute(texts)


def test_large_group_is_spooled(spark, monkeypatch):
    rnd = random.Random(9)
    passage = babble(rnd, 150)
    texts = [babble(rnd, 40) + passage[: 500 + k % 7] + babble(rnd, 40) for k in range(60)]
    plain = run(spark, texts)
    rows = [(1, k, 120, t.encode()[:520]) for k, t in enumerate(texts)]
    spooled = [again.tolist() for _, again in repeats._repeats_spooled(iter(rows), 400)]
    assert spooled == [x.tolist() for x in repeats._repeats_sorted(rows, 400)]
    assert plain == brute(texts)


def test_shared_and_missing_ids(spark):
    rnd = random.Random(10)
    a, b = babble(rnd, 200), babble(rnd, 300)
    rows = repeats.remove_repeats(docs(spark, [a, b, a, None, b[:50] + a], [1, 1, None, None, 5])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == sorted([(len(a.encode()), len(a.encode()))] * 2 + [(len(b.encode()), 0), (0, 0), (len((b[:50] + a).encode()), len(a.encode()))])


def test_no_rows(spark):
    assert run(spark, []) == []
