import os
import random

import pytest

from tests.llm import test_decontaminate, test_near_dup
from tests.llm.helpers import docs, sha

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = {"en": ["the", "river", "house", "walks", "green", "with", "quickly", "stone"], "fr": ["été", "être", "chaque", "maison", "où", "déjà", "leçon"], "de": ["schön", "größe", "zwischen", "nicht", "übung", "straße"]}
ITEM = "which of these small rivers flows through the old capital before it reaches the wide northern sea"


def table():
    rnd = random.Random(21)
    texts, langs = [], []
    for k in range(150):
        lang = rnd.choice(["en", "fr", "de"])
        lines = [" ".join(f"{w}{rnd.choice(['', 'a', 'ou', 'ten'])}" for w in rnd.choices(WORDS[lang], k=rnd.randint(6, 30))) for _ in range(rnd.randint(1, 4))]
        if k % 9 == 0:
            lines.append("  All Rights Reserved by nobody ")
        if k % 25 == 3:
            lines.append(f"so {ITEM} then")
        texts.append("\n".join(lines))
        langs.append(lang)
    for k in (5, 17, 40):
        texts.append(texts[k] + " more")
        langs.append(langs[k])
    texts += [None, "", "123 456 $$$", texts[8]]
    langs += [None, "en", "en", langs[8]]
    return texts, langs


def brute(texts, ids):
    import tiktoken

    from trustloom.llm.byte_bpe import read_ranks

    white = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(white))
    rows = [(i, t) for i, t in zip(ids, texts) if t is not None and any(c.isalpha() for c in t)]
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    rows = [(i, "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i)) for i, t in rows]
    kept = {r[0] for r in test_near_dup.brute([t for _, t in rows], [i for i, _ in rows], 5) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    leaks = {k for k, _ in test_decontaminate.brute([t for _, t in rows], [(1, ITEM)])}
    rows = [r for k, r in enumerate(rows) if k not in leaks]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return sorted((i, len(ids_), sha(" ".join(map(str, ids_))), sha(t), ids_) for i, t in rows for ids_ in [coder.encode_ordinary(t)])


def test_equals_brute_force_and_keeps_columns(spark, tmp_path):
    texts, langs = table()
    ids = [2 * k + 1 for k in range(len(texts))]
    docs(spark, texts, ids, langs).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got) == brute(texts, ids)
    df = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", "1 AS score", "2 AS lines", "3 AS rep")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_no_rows(spark, tmp_path):
    df = docs(spark, [])
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark_leaks", "tokens"] and os.path.exists(corpus_pipeline.__file__)
