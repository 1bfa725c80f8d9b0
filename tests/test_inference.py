import json
import os
import sys

import pytest
from pyspark import cloudpickle

from conftest import column
from cuespark.operators import inference
from cuespark.operators.inference import Pacer, calls_one_by_one
from cuespark.operators.label import label_posts
from cuespark.plans.backends import BracketBackend, CueBackend
from cuespark.schema import RESPONSES


# Backends defined here travel to the Python workers with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails on posts that contain `boom`, notes every call in a folder."""

    def __init__(self, folder=None):
        self.folder = folder

    def complete(self, prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("API Error")
        if self.folder:
            for p in prompts:
                with open(os.path.join(self.folder, f"{hash(p)}-{os.urandom(4).hex()}"), "w"):
                    pass
        return [json.dumps({"reasoning": "r", "answer": "FEMALE"}) for _ in prompts]


def test_one_failing_post_does_not_hurt_the_others(texts):
    df = inference.label_with_backend(texts("Text 1", "boom", "Text 3", None, ""), Flaky)
    assert column(df, "gender") == ["FEMALE", "NEUTRAL", "FEMALE", "NEUTRAL", "NEUTRAL"]
    assert column(df, "reasoning") == ["r", "Error: API Error", "r", "Empty text", "Empty text"]
    assert column(df, "confidence") == ["high", "low", "high", "high", "high"]


def test_equal_texts_are_asked_once_and_answers_reach_all(texts, tmp_path):
    folder = str(tmp_path)
    df = texts(*["same"] * 50, "other", None)
    labelled = inference.label_with_backend(df, lambda: Flaky(folder), store=f"{tmp_path}/store")
    assert labelled.count() == 52
    assert column(labelled, "gender") == ["FEMALE"] * 51 + ["NEUTRAL"]
    assert len([f for f in os.listdir(folder) if f != "store"]) == 2


def test_resume_asks_only_what_is_new(spark, texts, tmp_path):
    store, calls = f"{tmp_path}/store", tmp_path / "calls"
    calls.mkdir()
    asked = lambda: len(os.listdir(calls))
    make = lambda: Flaky(str(calls))
    inference.label_with_backend(texts("a", "b"), make, store=store).count()
    assert asked() == 2
    again = inference.label_with_backend(texts("a", "b", "c"), make, store=store, chunks=3)
    assert again.count() == 3 and asked() == 3
    inference.label_with_backend(texts("a", "b", "c"), make, store=store).count()
    assert asked() == 3


def test_errors_are_kept_unless_retried(texts, tmp_path):
    store = f"{tmp_path}/store"
    df = texts("boom", "a")
    assert column(inference.label_with_backend(df, Flaky, store=store), "gender")[0] == "NEUTRAL"
    kept = inference.label_with_backend(df, CueBackend, store=store)
    assert column(kept, "reasoning")[0] == "Error: API Error"
    retried = inference.label_with_backend(df, CueBackend, store=store, retry_errors=True)
    assert column(retried, "reasoning")[0] == "cues: "


def test_one_answer_each_prefers_good_ones(spark):
    rows = [("a", None, "e"), ("a", "x", None), ("a", "y", None), ("b", None, "e")]
    got = inference.one_answer_each(spark.createDataFrame(rows, RESPONSES)).collect()
    assert sorted(tuple(r) for r in got) == [("a", "x", None), ("b", None, "e")]


def test_backend_equals_rule_labels(texts):
    df = texts("He met her", "She left", "nothing", "his \"quoted\" text\nReply", "the same", "the same")
    asked = inference.label_with_backend(df, CueBackend, batch=2, parallelism=3)
    assert column(asked, "gender") == column(label_posts(df), "gender")
    assert column(asked, "reasoning") == column(label_posts(df), "reasoning")


def test_scrub_backend(texts):
    df = inference.scrub_with_backend(texts("my Wife left", "boom", None), BracketBackend)
    assert column(df, "scrubbed_text") == ["my [FAMILY_MEMBER] left", "boom", None]
    failed = inference.scrub_with_backend(texts("boom", "x"), Flaky, null_as_empty=True)
    assert column(failed, "scrubbed_text") == ["boom", "x"]
    assert column(failed, "scrub_status") == ["error", "unparsed"]


def test_calls_one_by_one():
    def call(items):
        if "bad" in items:
            raise ValueError("no")
        return [i.upper() for i in items]

    assert calls_one_by_one(call, ["a", "bad", "c"]) == [("A", None), (None, "no"), ("C", None)]
    assert calls_one_by_one(lambda items: [], ["a"]) == [(None, "0 results for 1 items")]


def test_pacer_keeps_the_rate():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    pacer = Pacer(600, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        pacer.wait()
    assert sum(slept) == pytest.approx(0.4)  # five requests, 0.1 s apart
    now[0] += 10
    pacer.wait()
    assert sum(slept) == pytest.approx(0.4)


def test_a_rate_needs_a_number_of_tasks(texts):
    with pytest.raises(ValueError):
        inference.label_with_backend(texts("a"), CueBackend, requests_per_minute=60)
    paced = inference.label_with_backend(
        texts("a", "b"), CueBackend, requests_per_minute=60000, parallelism=2)
    assert paced.count() == 2


def test_pending_is_an_anti_join(spark, texts):
    from cuespark.operators.label import label_prompt

    posts = texts("a", "b", "b", None, "")
    key_of = inference.request_hash(label_prompt, "raw_text")
    answers = posts.filter("raw_text = 'a'").select(key_of.alias("request_hash"))
    todo = inference.pending(posts, label_prompt, answers).collect()
    assert len(todo) == 1 and '"b"' in todo[0].prompt
    assert posts.filter(key_of.isNull()).count() == 2
