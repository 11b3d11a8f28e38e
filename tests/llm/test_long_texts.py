"""Texts with very many matches, and turns told apart in a conversation's whole text."""

import random
import time

import pytest

from tests.llm.helpers import docs, sha
from tests.llm.test_chat_format import brute as brute_turns
from tests.llm.test_chat_format import rows
from tests.llm.test_secrets import brute, said
from trustloom.llm import chat_format, secrets


def test_a_megabyte_with_50000_matches(spark):
    text = "deadbeefdeadbeef01 " * 50_000
    model = [-100] * (len(secrets.ALPHABET) * (len(secrets.ALPHABET) + 1))
    begin = time.time()
    got = secrets.report(secrets.scan(docs(spark, [text, "x"]), model)).orderBy("doc_id").first()
    assert got.n_hex == 50_000 and got.base_sha256 == sha(said(brute(text))) and time.time() - begin < 60


def test_turns_are_told_apart_in_one_text():
    t = chat_format.ChatTemplate()
    turns = [("user", "a\\"), ("assistant", " </turn>\n### User: b </turn>\n"), ("a:: b\\", "x"), ("user", ""), ("", "### Role ::"), ("assistant", "\\\\### ")]
    text = "".join(x for r, s in turns for x, _ in t.segments(r, s))
    assert list(t.read(text)) == turns
    for step in (1, 2, 7, 50):
        reader = chat_format.TurnReader(t)
        assert [x for k in range(0, len(text), step) for x in reader.feed(text[k : k + step])] == turns
        reader.close()
    for broken in (text[:-1], text[: len(text) // 2]):
        with pytest.raises(ValueError):
            list(t.read(broken))
    with pytest.raises(ValueError):
        list(t.read("x" + text))


def test_whole_conversations_are_joined(spark, monkeypatch):
    rnd = random.Random(51)
    monkeypatch.setattr(chat_format, "READ_CHARS", 300)
    data = [(rnd.choice([1, 2, None]), k, rnd.choice(["user", "assistant", "tool"]), "\\" * rnd.randint(0, 3) + "### User: " * rnd.randint(0, 3) + "</turn>" * rnd.randint(0, 2)) for k in range(300)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(chat_format.format_turns(rows(spark, data))).collect()}
    assert got == brute_turns(data)
