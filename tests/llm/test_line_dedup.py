import random

from tests.llm.helpers import ODD, docs, sha
from trustloom.llm import line_dedup


def brute(texts, ids):
    white = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))
    holders = {}
    for t, i in zip(texts, ids):
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(i)
    out = []
    for t, i in zip(texts, ids):
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def run(spark, texts, ids):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(docs(spark, texts, ids), digest=True).collect()), key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"  Line number {k % 40} É " if k % 3 else f"LINE number {k % 40} É\t" for k in range(120)] + ["short", "", "ÀÀÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀÀÀ"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randint(0, 9))) for _ in range(150)] + ODD
    ids = [1000 - 2 * k for k in range(len(texts))]
    ids[5], ids[7] = ids[4], None
    assert run(spark, texts, ids) == brute(texts, ids)


def test_hot_line_and_clashing_columns(spark):
    texts = [f"a line that all documents hold\nown line of document {k}" for k in range(500)]
    df = docs(spark, texts).selectExpr("doc_id", "text", "1 AS line", "2 AS keeper", "3 AS lines", "4 AS id")
    rows = line_dedup.dedup_lines(df).collect()
    assert sum(r.n_dropped for r in rows) == 499 and {r.kept_text for r in rows if r.doc_id} == {t.split("\n")[1] for t in texts[1:]}


def test_no_rows(spark):
    assert run(spark, [], []) == []
