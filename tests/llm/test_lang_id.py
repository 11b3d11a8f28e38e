import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from trustloom.llm import lang_id

SYLLABLES = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["sch", "ein", "ung", "für"], "cc": ["ción", "los", "que", "ñar"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(1)
    langs = [rnd.choice("abc") * 2 for _ in range(240)]
    return [text(rnd, x, rnd.choice([3, 20, 400])) for x in langs], langs


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = lang_id.ByteGru(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, inside, label = rng.integers(0, 256, (6, 4)), np.ones((6, 4), bool), np.array([0, 1, 2, 1])
    inside[4:, 2] = inside[1:, 3] = False
    _, grads = net.gradients(x, inside, label)
    for k, w in net.p.items():
        flat, j = w.reshape(-1), int(np.abs(grads[k]).argmax())
        kept, step = flat[j], 1e-3
        flat[j] = kept + step
        up = net.gradients(x, inside, label)[0]
        flat[j] = kept - step
        down = net.gradients(x, inside, label)[0]
        flat[j] = kept
        assert (up - down) / (2 * step) == pytest.approx(grads[k].reshape(-1)[j], rel=2e-3, abs=1e-5)


def test_held_out_accuracy_and_odd_rows(spark, table):
    texts, langs = table
    texts, langs = texts + ODD + ["123 $$$ !!", "é"], langs + [None] * (len(ODD) + 2)
    rows = {r.doc_id: r for r in lang_id.predict(docs(spark, texts, langs=langs)).collect()}
    assert len(rows) == len(texts)
    test = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(rows[k].held_out == (k in test) for k in range(240))
    assert sum(rows[k].lang_pred == langs[k] for k in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in rows.values())
    for k, t in enumerate(texts):
        assert (rows[k].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_labels_every_position_and_pools_them(spark, table):
    net = lang_id.fit([(t[:80], x) for t, x in zip(*table)], ["aa", "bb", "cc"], steps=60)
    raw = (table[0][0] * 9).encode()
    labels = net.labels(raw)
    assert labels.shape == (len(raw), 3)
    pooled = net.pooled(np.array([0, len(raw), len(raw)]), np.frombuffer(raw, np.uint8))
    assert np.allclose(pooled[0], labels.mean(axis=0), atol=1e-4) and not pooled[1].any()


def test_nothing_labelled_and_no_rows(spark):
    assert [(r.lang_pred, r.score) for r in lang_id.predict(docs(spark, ["abc"], langs=[None])).collect()] == [("und", 0.0)]
    assert lang_id.predict(docs(spark, [])).count() == 0
