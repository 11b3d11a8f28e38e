"""Calls of clients: retries, pace, errors, top log-probabilities."""

import asyncio

import pytest

from trustloom.sources import asking


class Client:
    temperature = 0.7

    def __init__(self):
        self.calls = 0

    async def ask(self, messages, top_logprobs=None):
        self.calls += 1
        if messages[-1]["content"] == "bad":
            raise ValueError("never")
        if messages[-1]["content"] == "shy" and self.calls < 3:
            raise ConnectionError("later")
        return {"content": f"{messages[0]['content']}|{messages[-1]['content']}|{top_logprobs}", "metadata": {"logprobs_result": [{"token": "x", "logprob": -1.0}]}}


class Cold(Client):
    temperature = 0


class Plain(Client):
    async def ask(self, messages):
        return {"content": "plain"}


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "prompt_id long, prompt string")


def test_each_prompt_is_asked(spark):
    rows = asking.ask(prompts(spark, "one", "bad", None, ""), Client, count=2, system="be kind", top_logprobs=3, retries=1, pause=0, errors="keep").orderBy("prompt_id", "sample_idx").collect()
    assert [(r.prompt_id, r.sample_idx) for r in rows] == [(p, s) for p in range(4) for s in range(2)]
    assert rows[0].text == "be kind|one|3" and rows[0].error is None and "logprobs_result" in rows[0].metadata
    assert (rows[2].text, rows[2].error) == (None, "ValueError: never") and (rows[4].text, rows[4].error) == (None, None) and rows[6].text == "be kind||3"
    assert asking.ask(prompts(spark, "one"), Plain, top_logprobs=3).first().text == "plain"
    assert asking.ask(prompts(spark), Client).count() == 0
    limited = asking.ask(prompts(spark, *"abcdef"), Client, max_calls_per_min=600, lanes=2)
    assert limited.rdd.getNumPartitions() == 2 and limited.count() == 6


def test_errors_and_arguments(spark):
    with pytest.raises(Exception, match="never"):
        asking.ask(prompts(spark, "bad"), Client, retries=0).collect()
    for wrong in ({"count": 0}, {"errors": "hide"}):
        with pytest.raises(ValueError):
            asking.ask(prompts(spark, "one"), Client, **wrong)
    with pytest.raises(ValueError):
        asking.ask(prompts(spark, "one"), Cold, count=2)


def test_retries():
    said, none = [{"role": "user", "content": "shy"}], asking.Pace(None)
    reply = lambda retries: asyncio.run(asking.reply_of(Client(), said, None, retries, 0.0, none))
    assert reply(2)[0] is not None and isinstance(reply(1)[1], ConnectionError)


def test_pace():
    clock = [0.0]
    pace = asking.Pace(2, 60.0, lambda: clock[0])
    assert [pace.wait() for _ in range(5)] == [0, 0, 60, 60, 120]
    clock[0] = 500.0
    assert pace.wait() == 0 and asking.Pace(None).wait() == 0
