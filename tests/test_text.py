"""Text expressions against Python's `re` and `str`, on Unicode input."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import column
from cuespark.functions import text as tx
from cuespark.functions.hashing import row_key, seeded_unit

SAMPLES = [
    "", " ", "\t\n", " ", " 　", "\x1c\x1f", "a", " a b ", " x \n",
    "éhe he", "he_she she", "HE  she\nHer", "²he he²", "ſhe she", "[a] [b\nc] [d\re] []",
    "[PRONOUN] met [PRONOUN_OBJECT]", "日本 he 語", "one two", "éhe he",
]


def test_blank_and_strip(texts):
    df = texts(*SAMPLES).select(
        "post_id", tx.is_blank(F.col("raw_text")).alias("b"), tx.strip(F.col("raw_text")).alias("s")
    )
    assert column(df, "b") == [s.strip() == "" for s in SAMPLES]
    assert column(df, "s") == [s.strip() for s in SAMPLES]


def test_word_count(texts):
    df = texts(*SAMPLES, None).select("post_id", tx.word_count(F.col("raw_text")).alias("n"))
    assert column(df, "n") == [len(s.split()) for s in SAMPLES] + [0]


@pytest.mark.parametrize("words", [["he", "she"], ["her", "hers"], ["mr", "mrs", "ms"]])
def test_any_word_is_a_whole_word(texts, words):
    pattern = re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE)
    samples = SAMPLES + ["Mrs.Smith mr. MS", "hers her herself HER", "she's he-she"]
    df = texts(*samples).select(
        "post_id", F.regexp_extract_all("raw_text", F.lit(tx.any_word(words)), F.lit(0)).alias("m")
    )
    assert column(df, "m") == [pattern.findall(s) for s in samples]


def test_tokens(texts):
    df = texts(*SAMPLES).select("post_id", tx.tokens(F.col("raw_text")).alias("t"))
    assert column(df, "t") == [re.findall(r"\w+", s.lower()) for s in SAMPLES]


def test_bracket_and_literal_counts(texts):
    df = texts(*SAMPLES).select(
        "post_id",
        tx.bracket_count(F.col("raw_text")).alias("b"),
        tx.count_literal(F.col("raw_text"), "[PRONOUN]").alias("p"),
    )
    assert column(df, "b") == [len(re.findall(r"\[.*?\]", s)) for s in SAMPLES]
    assert column(df, "p") == [s.count("[PRONOUN]") for s in SAMPLES]


def test_snippet_and_cleanup(texts):
    long = "AB" * 80
    df = texts(long, "x", " a\nb ", None).select(
        "post_id",
        tx.snippet(F.col("raw_text")).alias("s"),
        tx.clean_for_encoder(F.col("raw_text")).alias("c"),
    )
    assert column(df, "s")[:2] == [long.lower()[:100] + "...", "x..."]
    assert column(df, "c") == [long, "x", "a b", ""]


def test_seeded_keys_are_uniform_and_stable(spark):
    df = spark.range(20000)
    mean, low, high = df.agg(
        F.avg(seeded_unit(F.col("id"), 1)), F.min(seeded_unit(F.col("id"), 1)),
        F.max(seeded_unit(F.col("id"), 1)),
    ).first()
    assert abs(mean - 0.5) < 0.01 and low >= 0 and high < 1
    keys = df.select(row_key(F.col("id")).alias("k")).distinct().count()
    assert keys == 20000


def test_strip_looks_at_the_ends_alone(texts):
    spaces = [" a b\U0001f600", "\U0001f600 a 　", "\U0001f600", "a\nb", " \U0001f600 ", "x\x1f"]
    df = texts(*spaces, None).select(
        "post_id", tx.strip(F.col("raw_text")).alias("s"), tx.clean_for_encoder(F.col("raw_text")).alias("c")
    )
    assert column(df, "s") == [s.strip() for s in spaces] + [None]
    assert column(df, "c") == [s.replace("\n", " ").strip() for s in spaces] + [""]
