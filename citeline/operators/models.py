"""Hooks for language models, with retries and deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS, PAUSE, EMBED_BATCH = 3, 1.5, 256


class ModelError(Exception):
    """A call that failed for good."""


class AuthError(ModelError):
    """Wrong credentials; not tried again."""


class RateLimitError(ModelError):
    """Too many calls; tried again like any failure, and told apart when all attempts are spent."""


def with_retries(call: Callable, *, attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; after each failure but the last it waits pause x attempt."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except AuthError:
            raise
        except ModelError:
            if attempt == attempts:
                raise
            sleep(pause * attempt)


def offline_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Words counted in buckets of their MD5; the same in every process."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for word in (text or "").lower().split():
            v[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1.0
        out.append(v)
    return out


def embed(df: DataFrame, text: str, into: str, model: Callable[[list[str]], list[list[float]]] = offline_embedding) -> DataFrame:
    """All rows with the vector of a text; the model sees EMBED_BATCH texts at a time, each call with retries."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = (values[i : i + EMBED_BATCH] for i in range(0, len(values), EMBED_BATCH))
            yield pd.Series([v for part in parts for v in with_retries(lambda part=part: model(part))])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


def complete(df: DataFrame, prompt: str, schema: str, model: Callable[[str], str]) -> DataFrame:
    """All rows with ``answer``: the model's JSON read with a declared schema; bad JSON fails the job."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(lambda p: with_retries(lambda: model(p)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    made = df.withColumn("_json", F.pandas_udf(run, "string")(F.col(prompt)))
    return made.withColumn("answer", F.from_json("_json", schema, {"mode": "FAILFAST"})).drop("_json")


def rewritten(message: Column, history: Column, proposal: Column) -> tuple[Column, Column]:
    """(question, whether rewritten): the proposal if there is a history and it is not blank, else the message."""
    given = (F.coalesce(history, F.lit("")) != "") & (F.trim(F.coalesce(proposal, F.lit(""))) != "")
    question = F.when(given, F.trim(proposal)).otherwise(message)
    return question, given & (question != F.trim(message))


def best_sentence(question: str, texts: list[str]) -> tuple[int, str]:
    """The offline answerer: the retrieved sentence that shares most words with the question, first on ties."""
    asked = set(question.lower().split())
    each = [(-len(asked & set(s.lower().split())), i, j, s) for i, t in enumerate(texts) for j, s in enumerate(t.split(". "))]
    _, i, _, s = min(each)
    return i, s
