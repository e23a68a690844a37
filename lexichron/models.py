"""Pluggable models. External inference is always a function that the caller may replace; the defaults are deterministic.

A generator takes a frame (question_id, question, prompt) and returns (question_id, reply), the reply being JSON
{"found": bool, "answer": str with [n] markers, "citations": [{"n": int, "quote": str}]}.
A recogniser takes a frame (episode_id, idx, audio) and returns (episode_id, idx, reply) with the reply's JSON words.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.jobs import retry_waits


def extractive(prompts: DataFrame) -> DataFrame:
    """The default generator: answers with the first eight words of the first passage and cites them."""
    body = F.regexp_replace(F.regexp_extract("prompt", r"(?s)^\[1\] Episode: .*?\n(.*?)(?:\n\n\[2\]|\z)", 1), r"\?", "")
    quote = F.array_join(F.slice(F.filter(F.split(body, r"\s+"), lambda w: w != ""), 1, 8), " ")
    reply = F.struct(F.lit(True).alias("found"), F.concat(quote, F.lit(" [1].")).alias("answer"), F.array(F.struct(F.lit(1).alias("n"), quote.alias("quote"))).alias("citations"))
    return prompts.select("question_id", F.to_json(reply).alias("reply"))


class RateLimited(Exception):
    def __init__(self, wait: float):
        super().__init__(f"rate limited for {wait} s")
        self.wait = wait


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, most_wait: float = 65.0) -> str:
    """Calls a model up to five times: waits as long as a rate limit says (not over most_wait), and 1, 2, 4, 8 s after
    network and server errors. Other errors are raised at once."""
    waits = retry_waits()
    for i, wait in enumerate([*waits, None]):
        try:
            return call()
        except RateLimited as e:
            if wait is None or e.wait > most_wait:
                raise
            sleep(e.wait)
        except (ConnectionError, TimeoutError):
            if wait is None:
                raise
            sleep(waits[i])
    raise AssertionError("unreachable")


#: Models that this Python worker has loaded, by name.
_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of that name, loaded on its first use in a Python worker and kept for all later tasks there."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def asking(name: str, load: Callable[[], Callable[[str], str]], sleep: Callable[[float], None] = time.sleep, most_wait: float = 65.0) -> Callable[[DataFrame], DataFrame]:
    """A generator (see above) that asks a model on the executors: load() gives a function from a prompt to a reply, once a
    Python worker, and each call goes through with_retries.

    The frame it makes has, besides question_id and reply, tries and error: a prompt whose calls all fail has no reply, and
    the others go on.
    """

    def one(model: Callable[[str], str], prompt: str) -> tuple[str | None, int, str | None]:
        tries = 0

        def call() -> str:
            nonlocal tries
            tries += 1
            return model(prompt)

        try:
            return with_retries(call, sleep, most_wait), tries, None
        except Exception as e:  # whatever a model raises belongs to its prompt
            return None, tries, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, load)
        for pdf in frames:
            made = [one(model, p) for p in pdf["prompt"]]
            yield pd.DataFrame({"question_id": pdf["question_id"], "reply": [m[0] for m in made], "tries": [m[1] for m in made], "error": [m[2] for m in made]})

    return lambda prompts: prompts.select("question_id", "prompt").mapInPandas(run, "question_id bigint, reply string, tries int, error string")


def embedding(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Callable[[DataFrame], DataFrame]:
    """An embedder, (id, text) -> (id, embedding): load() gives a function from texts to rows of numbers, once a Python worker,
    which gets `batch` texts at a time."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()
        return lambda texts: np.asarray(model([str(t) for t in texts]), np.float32)

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return lambda docs: docs.filter("text IS NOT NULL").select("id", udf(F.col("text")).alias("embedding"))
