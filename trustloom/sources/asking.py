"""Responses of a client: many calls at once in a task, paced, tried again, and their errors told or raised.

A client is any object with ``async ask(messages, top_logprobs=None)`` that
returns {"content": str, "metadata": dict}.  Each task makes its own, so
connections and keys never leave the executor.  A task that is lost asks again:
write what comes out to a table before anything is built on it.
"""

from __future__ import annotations

import asyncio
import json
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.sources.datasets import messages

ROW = "prompt_id long, sample_idx int, text string, metadata string, error string"


class Pace:
    """At most ``calls`` begin in any ``window`` seconds; None: no limit."""

    def __init__(self, calls: int | None, window: float = 61.0, now: Callable[[], float] = time.monotonic):
        self.calls, self.window, self.now = calls, window, now
        self.begun: deque[float] = deque()

    def wait(self) -> float:
        """Seconds until the next call may begin, which counts as begun then."""
        if not self.calls:
            return 0.0
        now = at = self.now()
        if len(self.begun) == self.calls:
            at = max(now, self.begun.popleft() + self.window)
        self.begun.append(at)
        return at - now


async def reply_of(client, said: list[dict], top_logprobs: int | None, retries: int, pause: float, pace: Pace) -> tuple[dict | None, Exception | None]:
    """The reply, or the last error after ``retries`` more tries, each after twice the pause.

    A client that doesn't take ``top_logprobs`` (TypeError) is asked without, which isn't a retry.
    """
    attempt = 0
    while True:
        await asyncio.sleep(pace.wait())
        try:
            return (await client.ask(said, top_logprobs=top_logprobs) if top_logprobs else await client.ask(said)), None
        except TypeError as e:
            if not top_logprobs:
                return None, e
            top_logprobs = None
        except Exception as e:  # whatever the client raises may pass
            if attempt == retries:
                return None, e
            await asyncio.sleep(pause * 2**attempt)
            attempt += 1


def ask(
    prompts: DataFrame, make_client: Callable[[], object], count: int = 1, system: str = "You are a helpful assistant.", top_logprobs: int | None = None,
    max_calls_per_min: int | None = None, lanes: int = 8, at_once: int = 32, retries: int = 3, pause: float = 1.0, errors: str = "raise",
) -> DataFrame:
    """(prompt_id, sample_idx, text, metadata, error): ``count`` responses to each (prompt_id, prompt).

    metadata is JSON as ``normalized_logprobs`` reads it.  With a limit of calls,
    prompts are dealt to at most ``lanes`` tasks, which share it; without one, they
    stay in their partitions.  errors: ``raise`` fails the job with the client's
    last error, ``keep`` gives a null text and says the error.  A null prompt isn't
    asked and has a null text and no error.
    """
    if errors not in ("raise", "keep"):
        raise ValueError("errors must be raise or keep")
    if count < 1:
        raise ValueError("count must be 1 or more")
    if count > 1 and getattr(make_client(), "temperature", None) == 0:
        raise ValueError("samples need a temperature above 0")
    share = None
    rows = prompts.select("prompt_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample_idx"))
    if max_calls_per_min:
        lanes = max(1, min(lanes, max_calls_per_min))
        share, rows = max_calls_per_min // lanes, rows.repartition(lanes)

    def run(frames):
        import pandas as pd

        client, pace = make_client(), Pace(share)

        async def whole(frame):
            gate = asyncio.Semaphore(at_once)

            async def one(said):
                if said is None:
                    return None, None
                async with gate:
                    return await reply_of(client, [{"role": m["role"], "content": m["content"]} for m in said], top_logprobs, retries, pause, pace)

            return await asyncio.gather(*[one(m) for m in frame["messages"]])

        with asyncio.Runner() as loop:
            for frame in frames:
                got = loop.run(whole(frame))
                if errors == "raise":
                    for _, e in got:
                        if e is not None:
                            raise e
                yield pd.DataFrame({
                    "prompt_id": frame["prompt_id"], "sample_idx": frame["sample_idx"], "text": [None if r is None else str(r["content"]) for r, _ in got],
                    "metadata": [None if r is None else json.dumps(r.get("metadata") or {}) for r, _ in got], "error": [None if e is None else f"{type(e).__name__}: {e}" for _, e in got],
                })

    said = F.when(F.col("prompt").isNotNull(), messages(F.col("prompt"), system))
    return rows.select("prompt_id", "sample_idx", said.alias("messages")).mapInPandas(run, ROW)
