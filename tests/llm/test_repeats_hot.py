"""Names with more contexts than one sort takes, and shared passages shorter than the removed ones."""

import random

import pytest

from tests.llm.helpers import ODD, docs
from tests.llm.test_repeats import babble, brute, run
from trustloom.llm import repeats


@pytest.mark.parametrize("most", [3_000, 20_000])
def test_large_names_are_recursed_on(spark, monkeypatch, most):
    rnd = random.Random(21)
    long, short, edge = babble(rnd, 150), babble(rnd, 60)[:401], babble(rnd, 90)
    texts = [babble(rnd, 40) + long[: 500 + k % 7] + babble(rnd, 40) for k in range(60)]
    # edges that vary by a few bytes, shared by some of them only
    texts += [babble(rnd, 30) + rnd.choice(["ab", "b", "cab", ""]) + short + rnd.choice(["x", "xy", "xyz" * 60, ""]) + babble(rnd, 30) for _ in range(60)]
    texts += [edge[k % 37 : 420 + k % 91] + babble(rnd, rnd.choice([0, 0, 20])) for k in range(80)] + [edge] * 3 + ODD[:7] + ["q" * 1500] * 2
    want = brute(texts)
    monkeypatch.setattr(repeats, "SORTED", most)
    taken = []
    monkeypatch.setattr(repeats, "bounded_names", lambda *a, of=repeats.bounded_names: taken.append(1) or of(*a))
    assert run(spark, texts) == want and taken


def test_equal_rows_in_number(spark):
    rnd = random.Random(22)
    text, other = babble(rnd, 200), babble(rnd, 100)
    df = docs(spark, [text] * 40 + [other, text[:450] + other], [None] * 40 + [1, 2])
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect())
    a, b, c = (len(x.encode()) for x in (text, other, text[:450] + other))
    assert got == sorted([(a, a)] * 40 + [(b, b if b >= 400 else 0), (c, c if b >= 400 else len(text[:450].encode()))])


def test_shared_passages_of_51_words(spark):
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(3, 6)))
    said = lambda n: " ".join(word() for _ in range(n))
    passage = said(51)
    assert len(passage) < 400
    texts = [f"{said(70)} {passage} {said(33)}", f"{said(9)}\n{passage.upper()}\t{said(80)}", passage, said(200), f"{said(60)} {passage[:100]} {said(60)}", said(50), *ODD]
    df = docs(spark, texts).selectExpr("*", "1 AS row", "2 AS more", "3 AS runs", "4 AS name")
    rows = {r.doc_id: r for r in repeats.remove_repeats(df, digest=True, shared_words=51).collect()}
    assert len(rows) == len(texts) and all(rows[k].n_shared > 0 and rows[k].n_removed == 0 for k in range(3))
    assert not any(rows[k].n_shared for k in (3, 4, 5)) and [tuple(rows[k])[:5] for k in sorted(rows)] == brute(texts)
    # lines in common that are shorter than a sampled string don't count, and a document isn't another one to itself
    line = said(31)
    rows = repeats.remove_repeats(docs(spark, [f"{said(40)} {line} {said(40)}", f"{said(40)} {line}", f"{passage} {passage}"]), shared_words=51).collect()
    assert not any(r.n_shared for r in rows)
    assert repeats.remove_repeats(docs(spark, []), shared_words=51).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(spark, []), shared_words=31)


def test_long_rows_are_sampled_alike(spark, monkeypatch):
    rnd = random.Random(24)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(3, 6))) for _ in range(3000)), "z" * 9000 + " " + babble(rnd, 700) + " " + "w" * 5000]
    both = docs(spark, texts * 2, [1, 2, 3, 4])
    plain = {r.doc_id: r.n_shared for r in repeats.remove_repeats(both, shared_words=51).collect()}
    monkeypatch.setattr(repeats, "SEGMENT", 2000)
    cut = {r.doc_id: r.n_shared for r in repeats.remove_repeats(both, shared_words=51).collect()}
    assert plain == cut and plain[1] == plain[3] > 150 and plain[2] == plain[4] > 30
