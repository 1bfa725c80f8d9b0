"""Batch inference: requests, answers, and a resumable run of a pluggable backend.

A backend is made once per task, inside the task.  Equal prompts are asked once.  Answers go to
an append-only Parquet table; a run asks only what has no answer there yet, so a killed job
goes on where it stopped.  Tasks may be retried: the answer table is read with one answer per
request.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from cuespark.operators.joins import join_many_to_one
from cuespark.operators.label import apply_label_policy, label_prompt
from cuespark.operators.scrub import apply_scrub_policy, scrub_prompt
from cuespark.schema import RESPONSES, require_columns
from cuespark.session import work_folder


class TextBackend(Protocol):
    """Answers prompts.  An exception concerns the whole call, which is then split up."""

    def complete(self, prompts: list[str]) -> list[str]: ...


Prompt = Callable[[Column], Column]
_PENDING = "request_hash string, prompt string"


def request_hash(prompt: Prompt, text: str) -> Column:
    """Key of a text's prompt; NULL for an empty text, which is never sent."""
    return F.sha2(F.when(F.col(text) != "", prompt(F.col(text))), 256)


def distinct_requests(posts: DataFrame, prompt: Prompt, text: str = "raw_text") -> DataFrame:
    """(request_hash, text), one row per prompt.

    Copies are dropped inside each task first, so none piles up.  Texts are shuffled without
    the wording around them, which is the same for all.
    """
    hashed = require_columns(posts, text).select(
        request_hash(prompt, text).alias("request_hash"), F.col(text).alias("text")
    )
    return hashed.filter(F.col("request_hash").isNotNull()).dropDuplicates(["request_hash"])


def pending(
    posts: DataFrame, prompt: Prompt, answers: DataFrame | None, text: str = "raw_text"
) -> DataFrame:
    """(request_hash, prompt) of everything without an answer.

    The anti-join finds the requests already partitioned by their hash.
    """
    todo = distinct_requests(posts, prompt, text)
    if answers is not None:
        todo = todo.join(answers.select("request_hash"), "request_hash", "left_anti")
    return todo.select("request_hash", prompt(F.col("text")).alias("prompt"))


def one_answer_each(answers: DataFrame, value: str = "raw") -> DataFrame:
    """One answer per request: a good one rather than an error, the smallest of several."""
    rank = F.struct(F.col("error").isNotNull(), F.col(value), F.col("error"))
    return (
        answers.groupBy("request_hash")
        .agg(F.min(rank).alias("_a"))
        .select("request_hash", F.col(f"_a.{value}").alias(value), "_a.error")
    )


def calls_one_by_one(call: Callable, items: list) -> list[tuple[object, str | None]]:
    """(result, error) per item: one call for all, single calls if that fails."""
    try:
        results = list(call(items))
        if len(results) != len(items):
            raise ValueError(f"{len(results)} results for {len(items)} items")
        return [(r, None) for r in results]
    except Exception as problem:
        if len(items) == 1:
            return [(None, str(problem) or type(problem).__name__)]
        return [pair for item in items for pair in calls_one_by_one(call, [item])]


class Pacer:
    """Keeps one task below its share of a request rate."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap = 60.0 / per_minute
        self.clock, self.sleep = clock, sleep
        self.free_at = clock()

    def wait(self, requests: int = 1) -> None:
        now = self.clock()
        if self.free_at > now:
            self.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.gap * requests


def run_calls(
    frames: Iterable[pd.DataFrame],
    payload: str,
    call: Callable,
    batch: int,
    pacer: Pacer | None,
) -> Iterator[tuple[pd.DataFrame, list[tuple[object, str | None]]]]:
    """Call in batches of at most `batch` rows; yields each slice with its results."""
    for frame in frames:
        for start in range(0, len(frame), batch):
            part = frame.iloc[start : start + batch]
            if pacer is not None:
                pacer.wait(len(part))
            yield part, calls_one_by_one(call, part[payload].tolist())


def ask(
    todo: DataFrame,
    make_backend: Callable[[], TextBackend],
    batch: int = 64,
    requests_per_minute: float | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Answer (request_hash, prompt) rows.  The rate is divided by the number of tasks."""
    if requests_per_minute is not None and parallelism is None:
        raise ValueError("a request rate needs the number of parallel tasks")
    if parallelism is not None:
        todo = todo.repartition(parallelism, "request_hash")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        pacer = requests_per_minute and Pacer(requests_per_minute / parallelism)
        for part, results in run_calls(frames, "prompt", backend.complete, batch, pacer or None):
            yield pd.DataFrame(
                {
                    "request_hash": part["request_hash"].to_numpy(),
                    "raw": [r for r, _ in results],
                    "error": [e for _, e in results],
                }
            )

    return todo.select("request_hash", "prompt").mapInPandas(answer, RESPONSES)


def read_answers(
    spark: SparkSession, path: str, schema: T.StructType = RESPONSES
) -> DataFrame:
    """The answer table; empty if no run has written one yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def run_backend(
    posts: DataFrame,
    prompt: Prompt,
    store: str,
    make_backend: Callable[[], TextBackend],
    text: str = "raw_text",
    chunks: int = 1,
    retry_errors: bool = False,
    **options,
) -> DataFrame:
    """Ask what the store does not answer yet, append, and return one answer per request.

    With `chunks` > 1 the requests are committed in that many slices of their hash, so a lost
    job loses one slice of work at most.
    """
    spark = posts.sparkSession
    answers = read_answers(spark, store)
    if retry_errors:
        answers = answers.filter(F.col("error").isNull())
    todo = pending(posts, prompt, answers, text)
    if chunks > 1:  # posts are read and prompts hashed once, then slot by slot
        slot = F.pmod(F.xxhash64("request_hash"), F.lit(chunks)).cast("int")
        waiting = work_folder(spark, "pending")
        todo.withColumn("slot", slot).write.partitionBy("slot").parquet(waiting)
        todo = spark.read.schema(f"{_PENDING}, slot int").parquet(waiting)
    for chunk in range(chunks):
        share = todo.filter(F.col("slot") == chunk).drop("slot") if chunks > 1 else todo
        ask(share, make_backend, **options).write.mode("append").parquet(store)
    return one_answer_each(read_answers(spark, store))


def _answered(posts, prompt, make_backend, key, text, store, options) -> DataFrame:
    """Posts with `raw` and `error`, also when very many of them share one prompt."""
    require_columns(posts, key, text)
    if store is not None:
        answers = run_backend(posts, prompt, store, make_backend, text, **options)
    else:
        answers = ask(pending(posts, prompt, None, text), make_backend, **options)
    hashed = posts.withColumn("request_hash", request_hash(prompt, text))
    return join_many_to_one(hashed, answers, "request_hash", spread_by=key)


def label_with_backend(
    posts: DataFrame,
    make_backend: Callable[[], TextBackend],
    key: str = "post_id",
    text: str = "raw_text",
    store: str | None = None,
    **options,
) -> DataFrame:
    """Label posts by a backend; exactly one row per input row."""
    answered = _answered(posts, label_prompt, make_backend, key, text, store, options)
    return apply_label_policy(answered, text).drop("request_hash", "raw", "error")


def scrub_with_backend(
    posts: DataFrame,
    make_backend: Callable[[], TextBackend],
    key: str = "post_id",
    text: str = "raw_text",
    store: str | None = None,
    null_as_empty: bool = False,
    **options,
) -> DataFrame:
    """Scrub posts by a backend; a failed call leaves the text as it was."""
    answered = _answered(posts, scrub_prompt, make_backend, key, text, store, options)
    scrubbed = apply_scrub_policy(answered, text, null_as_empty=null_as_empty)
    return scrubbed.drop("request_hash", "raw", "error")
