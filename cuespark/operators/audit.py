"""Reports on what scrubbing did and what it missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions import lexicon
from cuespark.functions.text import (
    WORD,
    any_word,
    bracket_count,
    count_literal,
    snippet,
    word_count,
)
from cuespark.operators.sampling import sample_rows
from cuespark.schema import require_columns
from cuespark.session import stored


def length_delta(df: DataFrame, text: str = "raw_text", scrubbed: str = "scrubbed_text"):
    """Mean shortening in characters; rows with a NULL side do not count."""
    return df.agg(F.avg(F.length(text) - F.length(scrubbed)).alias("avg_length_reduction"))


def scrub_impact(
    df: DataFrame, text: str = "raw_text", scrubbed: str = "scrubbed_text"
) -> DataFrame:
    """Lengths, word reduction and literal placeholder counts of a corpus: one row.

    `[PRONOUN]` is counted literally, so the longer pronoun placeholders are not part of it.
    """
    require_columns(df, text, scrubbed)
    before, after = (F.coalesce(F.col(c), F.lit("")) for c in (text, scrubbed))
    counts = {
        f"n_{name}": F.sum(count_literal(after, placeholder))
        for name, placeholder in lexicon.COUNTED_PLACEHOLDERS.items()
    }
    found = df.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.avg(F.length(before)).alias("avg_original_length"),
        F.avg(F.length(after)).alias("avg_scrubbed_length"),
        F.avg(word_count(before) - word_count(after)).alias("avg_word_reduction"),
        *[count.alias(name) for name, count in counts.items()],
    )
    return found.withColumn("total_replacements", sum((F.col(n) for n in counts), F.lit(0)))


def with_replacements(df: DataFrame, scrubbed: str = "scrubbed_text") -> DataFrame:
    return df.withColumn("num_replacements", bracket_count(F.col(scrubbed)))


def most_rewritten(
    df: DataFrame, key: str = "post_id", scrubbed: str = "scrubbed_text", n: int = 10
) -> DataFrame:
    """Keys and counts of the n posts with most replacements; ties by key.

    Texts take no part in the ranking, so every task hands on n small rows.
    """
    require_columns(df, key, scrubbed)
    return (
        with_replacements(df.select(key, scrubbed), scrubbed)
        .select(key, "num_replacements")
        .orderBy(F.desc_nulls_last("num_replacements"), key)
        .limit(n)
    )


def top_replacements(
    df: DataFrame, key: str = "post_id", scrubbed: str = "scrubbed_text", n: int = 10
) -> DataFrame:
    """The n most rewritten posts with all their columns; meant for a stored scrub result."""
    return df.join(F.broadcast(most_rewritten(df, key, scrubbed, n)), key)  # n rows


def gender_report(
    df: DataFrame, text: str = "raw_text", scrubbed: str = "scrubbed_text"
) -> DataFrame:
    """Replacements and mean lengths per label, to two places; unlabelled rows left out."""
    counted = with_replacements(require_columns(df, "gender", text, scrubbed), scrubbed)
    lengths = counted.select(
        "gender",
        "num_replacements",
        F.length(text).alias("_before"),
        F.length(scrubbed).alias("_after"),
    )
    return (
        lengths.filter(F.col("gender").isNotNull())
        .groupBy("gender")
        .agg(
            F.bround(F.avg("num_replacements"), 2).alias("replacements_mean"),
            F.bround(F.stddev_samp("num_replacements"), 2).alias("replacements_std"),
            F.max("num_replacements").alias("replacements_max"),
            F.bround(F.avg("_before"), 2).alias("original_length_mean"),
            F.bround(F.avg("_after"), 2).alias("scrubbed_length_mean"),
        )
    )


def audit_matches(text: Column, mode: str = "literal") -> Column:
    """array<struct(pattern, missed_cues)> over the patterns that hit.

    A dotted title counts in "literal" mode only if a word follows the dot directly, which
    is what its pattern says; "strict" drops that condition.
    """
    if mode not in ("literal", "strict"):
        raise ValueError("mode must be 'literal' or 'strict'")
    lowered = F.lower(text)
    found = []
    for name, words in lexicon.AUDIT_WORDS.items():
        pattern, ends = lexicon.audit_pattern(name), f"(?!{WORD})"
        if name == "title":
            pattern = pattern.removesuffix(r"\b") if mode == "strict" else pattern
            ends = "" if mode == "strict" else f"(?={WORD})"
        java = any_word([w.lower() for w in words], ends=ends)
        hits = F.regexp_extract_all(lowered, F.lit(java), F.lit(0))
        found.append(F.struct(F.lit(pattern).alias("pattern"), hits.alias("missed_cues")))
    return F.filter(F.array(*found), lambda m: F.size(m.missed_cues) > 0)


def scrub_issues(
    df: DataFrame,
    key: str = "post_id",
    scrubbed: str = "scrubbed_text",
    sample_size: int | None = 100,
    seed: int = 42,
    mode: str = "literal",
) -> DataFrame:
    """One row per (post, pattern) with cues left in the scrubbed text.

    The audit looks at a seeded sample; `sample_size=None` audits the corpus.
    """
    require_columns(df, key, scrubbed)
    looked_at = df.select(key, scrubbed)
    if sample_size is not None:
        looked_at = sample_rows(looked_at, sample_size, key, seed)
    text = F.coalesce(F.col(scrubbed), F.lit("None"))
    return looked_at.select(
        key, snippet(text).alias("text_snippet"), F.inline(audit_matches(text, mode))
    )


def issue_rate(
    df: DataFrame,
    key: str = "post_id",
    scrubbed: str = "scrubbed_text",
    sample_size: int | None = None,
    seed: int = 42,
    examples: int = 5,
) -> DataFrame:
    """Posts with issues, issues, issue rate and the ids of the first `examples` of these posts."""
    looked_at = require_columns(df, key, scrubbed).select(key, scrubbed)
    if sample_size is not None:
        looked_at = sample_rows(looked_at, sample_size, key, seed)
    # the counts are stored: the first posts with issues are asked of them, not of the texts again
    counted = stored(
        looked_at.select(
            F.col(key).alias("_key"),
            F.size(audit_matches(F.coalesce(F.col(scrubbed), F.lit("None")))).alias("_issues"),
        ),
        "issue-counts",
    )
    return counted.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.count_if(F.col("_issues") > 0).alias("texts_with_issues"),
        F.coalesce(F.sum("_issues"), F.lit(0)).cast("bigint").alias("total_issues"),
        F.try_divide(F.count_if(F.col("_issues") > 0), F.count(F.lit(1))).alias("issue_rate"),
    ).transform(_with_examples, counted.filter(F.col("_issues") > 0), ["_key"], examples)


def _with_examples(summary: DataFrame, rows: DataFrame, order: list, n: int) -> DataFrame:
    """A one-row summary with `examples`, the `_key` of the first n rows."""
    first = rows.select("_key", F.struct(*order).alias("_o")).orderBy("_o").limit(n)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("_o", "_key"))).alias("_e"))
    one = listed.select(F.col("_e._key").alias("examples"))
    both = summary.unionByName(one, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def modification_summary(
    df: DataFrame,
    key: str = "post_id",
    text: str = "raw_text",
    scrubbed: str = "scrubbed_text",
    examples: int = 5,
) -> DataFrame:
    """How many posts changed, what they gained, and the ids of those that gained most."""
    before, after = (F.coalesce(F.col(c), F.lit("")) for c in (text, scrubbed))
    gained = (bracket_count(after) - bracket_count(before)).alias("_gained")
    rows = stored(
        df.select(F.col(key).alias("_key"), (before != after).alias("_modified"), gained), "modifications"
    )
    replaced = F.when(F.col("_modified"), F.col("_gained"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.count_if("_modified").alias("texts_modified"),
        F.try_divide(F.count_if("_modified"), F.count(F.lit(1))).alias("modification_rate"),
        F.avg(replaced).alias("avg_words_replaced"),
        F.max(replaced).alias("max_words_replaced"),
    ).transform(
        _with_examples, rows.filter("_modified"), [-F.col("_gained"), F.col("_key")], examples
    )
