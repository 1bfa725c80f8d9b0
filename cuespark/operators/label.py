"""Labelling: prompts, answer policy, and a rule labeller that needs no backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions import lexicon
from cuespark.functions.responses import parse_label
from cuespark.functions.text import any_word, is_blank
from cuespark.schema import FEMALE, LABELS, MALE, NEUTRAL, require_columns

_PROMPT_HEAD = (
    "Decide whether the person a forum post is mainly about is FEMALE, MALE or NEUTRAL.\n"
    "Judge the people discussed and not the author, unless the author is the subject.\n"
    "Evidence: pronouns, family words, titles, gendered nouns and first names.\n"
    "Answer NEUTRAL if the evidence is mixed or missing.\n\n"
    'Post: "'
)
_PROMPT_TAIL = (
    '"\n\nReply with one JSON object. Its field "reasoning" explains the evidence step by step, '
    'its field "answer" is FEMALE, MALE or NEUTRAL.\n'
    'Example: {"reasoning": "The post says \'my sister\' and \'she\'.", "answer": "FEMALE"}\n'
    "JSON:"
)


def label_prompt(text: Column) -> Column:
    return F.concat(F.lit(_PROMPT_HEAD), text, F.lit(_PROMPT_TAIL))


def apply_label_policy(
    df: DataFrame, text: str = "raw_text", raw: str = "raw", error: str = "error"
) -> DataFrame:
    """Add gender, reasoning and confidence from a backend's answer.

    Empty text: NEUTRAL, "Empty text", high.  Failed call or malformed JSON shape: NEUTRAL,
    "Error: ...", low.  Otherwise the parsed answer, with high confidence if it gives a reason.
    """
    require_columns(df, text, raw, error)
    given = df.withColumn("_answer", parse_label(F.col(raw)))
    empty = F.col(text).isNull() | (F.col(text) == "")
    problem = F.coalesce(
        F.col(error), F.col("_answer.parse_error"), F.when(F.col(raw).isNull(), F.lit("no answer"))
    )
    reasoning = F.col("_answer.reasoning")
    return given.select(
        *df.columns,
        F.when(empty | problem.isNotNull(), F.lit(NEUTRAL))
        .otherwise(F.col("_answer.gender"))
        .alias("gender"),
        F.when(empty, F.lit("Empty text"))
        .when(problem.isNotNull(), F.concat(F.lit("Error: "), problem))
        .otherwise(reasoning)
        .alias("reasoning"),
        F.when(empty, F.lit("high"))
        .when(problem.isNull() & (F.length(reasoning) > 0), F.lit("high"))
        .otherwise(F.lit("low"))
        .alias("confidence"),
    )


def cues(text: Column) -> Column:
    """All gendered words of a text, lower-cased, in order."""
    pattern = any_word(lexicon.words_of())
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def rule_gender(found: Column) -> Column:
    """FEMALE / MALE if the cues found are of that side only, else NEUTRAL."""

    def side(words: list[str]) -> Column:
        return F.arrays_overlap(found, F.array(*map(F.lit, words)))

    female, male = side(lexicon.words_of(FEMALE)), side(lexicon.words_of(MALE))
    return (
        F.when(female & ~male, F.lit(FEMALE)).when(male & ~female, F.lit(MALE)).otherwise(NEUTRAL)
    )


def label_posts(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Rule labels for every row: one Project, no shuffle.

    Adds gender, reasoning, confidence and the alias column `text`.
    """
    require_columns(df, text)
    column = F.col(text)
    empty = column.isNull() | is_blank(column)
    found = F.array_distinct(cues(column))
    return df.select(
        *df.columns,
        *([] if text == "text" else [column.alias("text")]),
        F.when(empty, F.lit(NEUTRAL)).otherwise(rule_gender(found)).alias("gender"),
        F.when(empty, F.lit("Empty text"))
        .otherwise(F.concat(F.lit("cues: "), F.array_join(F.array_sort(found), " ")))
        .alias("reasoning"),
        F.lit("high").alias("confidence"),
    )


def cue_hits(df: DataFrame, key: str = "post_id", text: str = "raw_text") -> DataFrame:
    """(key, token, cue_class, side, hits): how often each cue occurs in each post.

    Hits are counted inside the row, so nothing is shuffled; the lexicon is a literal table.
    """
    require_columns(df, key, text)
    table = df.sparkSession.createDataFrame(
        lexicon.lexicon_rows(), "token string, cue_class string, side string"
    )
    found = df.select(key, cues(F.col(text)).alias("_cues"))
    counted = found.select(
        key,
        F.explode(
            F.transform(
                F.array_distinct("_cues"),
                lambda t: F.struct(
                    t.alias("token"),
                    F.size(F.filter("_cues", lambda c: c == t)).cast("bigint").alias("hits"),
                ),
            )
        ).alias("_hit"),
    )
    return (
        counted.select(key, "_hit.token", "_hit.hits")
        .join(F.broadcast(table), "token")  # a fixed word list
        .select(key, "token", "cue_class", "side", "hits")
    )


def label_counts(df: DataFrame, column: str = "gender") -> DataFrame:
    """Count and share of every label; partial aggregation leaves one row per label and task."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # The shares need the total of a table with one row per label: fold it into one row.
    folded = counts.agg(
        F.sum("n").alias("_total"), F.collect_list(F.struct(column, "n")).alias("_rows")
    )
    return folded.select("_total", F.inline("_rows")).select(
        column, "n", (F.col("n") / F.col("_total") * 100).alias("share")
    )


def label_agreement(old: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """Agreement of two labellings of the same posts: one row.

    `old` is usually a sample; Spark picks the join by size.
    """
    pair = old.select(key, F.col("gender").alias("_old")).join(
        new.select(key, F.col("gender").alias("_new")), key
    )
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return pair.agg(
        F.count_if(same).alias("agreements"),
        F.count_if(~same).alias("disagreements"),
        F.try_divide(F.count_if(same), F.count(F.lit(1))).alias("agreement_rate"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def domain_violations(df: DataFrame, column: str = "gender") -> DataFrame:
    """Rows whose label is missing or outside the domain."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*LABELS))
