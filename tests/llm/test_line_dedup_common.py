"""One line that most documents hold, beside rare ones."""

import random

import pytest

from tests.llm.helpers import ODD, docs, sha
from trustloom.llm import line_dedup


def brute(texts, ids):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(white))
    holders = {}
    for i, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_common_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_COMMON", most)
    rnd = random.Random(61)
    pool = [f"some rare line number {k}" for k in range(150)]
    texts = ["\n".join(rnd.sample([" All Rights Reserved here\t", "the second common line", *rnd.choices(pool, k=5), "short", ""], k=7)) for _ in range(300)] + ODD
    ids = rnd.sample(range(10_000), len(texts))
    df = docs(spark, texts, ids).selectExpr("*", "1 AS line", "2 AS keeper", "3 AS n", "4 AS id", "5 AS lines")
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(df, digest=True).collect())
    assert got == brute(texts, ids)
