"""n-gram overlap of programs, against counting in Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trustloom.operators import code_scores as code


def bleu(r, c, weighted):
    total = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (r, c))
        weight = lambda g: 5.0 if weighted and n == 1 and g[0] in code.KEYWORDS else 1.0  # noqa: B023, E731
        total += math.log((sum(weight(g) * min(k, a[g]) for g, k in b.items()) + 1) / (sum(weight(g) * k for g, k in b.items()) + 1)) / 4
    return math.exp(total) * (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) if c else 0.0


def test_overlap_counts_grams(spark):
    rnd = random.Random(2)
    words = ["def", "f", "(", ")", "x", "+", "return", "if", "1", ":", "\n    ", "for", "in", "=="]
    said = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 25)))
    df = spark.createDataFrame([(k, said(), said()) for k in range(40)], "prompt_id long, original string, sample string")
    tokens = {r.prompt_id: (r.o, r.s) for r in df.select("prompt_id", code.code_tokens(F.col("original")).alias("o"), code.code_tokens(F.col("sample")).alias("s")).collect()}
    got = {r.prompt_id: r.codebleu for r in code.codebleu(df).collect()}
    assert got == pytest.approx({k: (bleu(o, s, False) + bleu(o, s, True)) / 2 for k, (o, s) in tokens.items()})
