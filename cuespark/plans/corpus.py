"""Forum posts, model answers and predictions derived from the available tables.

Every row of `documents` becomes a post: a cue sentence followed by the whole text.  Every row
of `labels` adds a withdrawn revision whose text is missing or blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.operators.scrub import scrub
from cuespark.schema import FEMALE, MALE, NEUTRAL

CUE_SENTENCES = [
    ("My wife said she would bring her notes to the meeting.", FEMALE),
    ("His brother told him that he was late.", MALE),
    ("Mary Ann thanked O'Brien and Jean-Luc for the slides of the seminar.", NEUTRAL),
    ("Mr. Smith and Mrs. Jones met John at noon.", NEUTRAL),
    ("She told her mother that HE saw himself in it.", FEMALE),
    ("Sarah and her sister thanked the lady herself.", FEMALE),
    ("A gentleman asked his son, and his son agreed.", MALE),
    ("Candidates [ranked] by field; nobody replied to ms.jones.", NEUTRAL),
]
# Setting: deal the documents to so many tasks.  For tables of one file on one machine, as in
# bench.py; unset, no text is shuffled.
TASKS = "cuespark.example.tasks"
BLANK_TEXT = " \t\n\u00a0 "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentence_of(number: Column) -> Column:
    """The cue sentence of a document's number."""
    which = F.pmod(number, F.lit(len(CUE_SENTENCES))).cast("int")
    return F.get(F.array(*[F.lit(s) for s, _ in CUE_SENTENCES]), which)


def posts_of_documents(documents: DataFrame) -> DataFrame:
    """post_id, thread_id, raw_text, gold, female_pred; works on a stream as well."""
    which = F.pmod("doc_id", F.lit(len(CUE_SENTENCES))).cast("int")
    sentence = sentence_of(F.col("doc_id"))
    gold = F.get(F.array(*[F.lit(g) for _, g in CUE_SENTENCES]), which)
    return documents.select(
        F.col("doc_id").alias("post_id"),
        F.pmod("doc_id", F.lit(97)).alias("thread_id"),
        F.concat(sentence, F.lit(" "), F.col("text")).alias("raw_text"),
        gold.alias("gold"),
        F.when(F.col("lang") == "en", 1.0)
        .when(F.col("lang").isin("de", "fr"), 0.0)
        .alias("female_pred"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    withdrawn = table(spark, sf_dir, "labels").select(
        (-1 - F.col("doc_id")).alias("post_id"),
        F.pmod("doc_id", F.lit(97)).alias("thread_id"),
        F.when(F.col("toxic") == 0, F.lit(BLANK_TEXT)).alias("raw_text"),
        F.lit(NEUTRAL).alias("gold"),
        F.col("quality").cast("double").alias("female_pred"),
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tasks = spark.conf.get(TASKS, None)
    if tasks:
        documents = documents.repartition(int(tasks), "doc_id")
    return posts_of_documents(documents).unionByName(withdrawn)


def _pick(shapes: list[Column], key: str = "post_id") -> Column:
    number = F.pmod(key, F.lit(len(shapes))).cast("int")
    chosen = F.when(number == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        chosen = chosen.when(number == i, shape)
    return chosen


def with_label_answers(df: DataFrame) -> DataFrame:
    """Add `raw` and `error`: the shapes of answer a labelling model gives, by post."""
    why = F.concat(F.lit("post "), F.col("post_id").cast("string"))

    def answer(value: str) -> Column:
        return F.concat(
            F.lit('{"reasoning": "'), why, F.lit(f'", "answer": {value}}}')
        )

    shapes = [
        answer('"FEMALE"'),
        F.concat(F.lit("```json\n"), answer('"MALE"'), F.lit("\n```")),
        F.concat(F.lit("```\n"), answer('"MALE"'), F.lit("\n```")),
        F.concat(F.lit("  \n"), answer('"female"'), F.lit(" \n")),
        answer('"UNKNOWN"'),
        F.concat(F.lit('{"reasoning": "'), why, F.lit('"}')),
        F.concat(F.lit("No object here, "), why),
        F.lit('{"reasoning": "", "answer": "NEUTRAL"}'),
        answer("null"),
        F.lit("[1]"),
        F.concat(answer('"MALE"'), F.lit(" extra")),
        answer('" MALE"'),
        F.lit(None).cast("string"),
    ]
    failed = F.pmod("post_id", F.lit(len(shapes))) == len(shapes) - 1
    return df.withColumn("raw", _pick(shapes)).withColumn(
        "error", F.when(failed, F.lit("rate limit"))
    )


def with_scrub_answers(df: DataFrame) -> DataFrame:
    """Add `raw` and `error`: answers of a scrubbing model around the whole scrubbed text."""
    good = F.to_json(F.struct(scrub(F.col("raw_text")).alias("scrubbed_text")))
    shapes = [
        good,
        F.concat(F.lit("```json\n"), good, F.lit("\n```")),
        F.concat(F.lit("```\n"), good, F.lit("```")),
        F.concat(F.lit("  "), good, F.lit("\n")),
        F.lit('{"scrubbed_text": 123}'),
        F.lit('{"scrubbed_text": ""}'),
        F.lit('{"note": "kept short"}'),
        F.concat(good, F.lit(" extra")),
        F.lit("no braces at all"),
        F.lit("[2]"),
        F.lit(None).cast("string"),
    ]
    failed = F.pmod("post_id", F.lit(len(shapes))) == len(shapes) - 1
    return df.withColumn("raw", _pick(shapes)).withColumn(
        "error", F.when(failed, F.lit("rate limit"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, gender, embedding."""
    gender = F.pmod("label", F.lit(3))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(gender == 0, FEMALE).when(gender == 1, MALE).otherwise(NEUTRAL).alias("gender"),
        "embedding",
    )


def vectors_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in which every fiftieth row has NaN in dimension 0."""
    gap = F.pmod("vec_id", F.lit(50)) == 0
    broken = F.transform(
        "embedding", lambda x, i: F.when(gap & (i == 0), F.lit(float("nan"))).otherwise(x)
    )
    return vectors(spark, sf_dir).withColumn("embedding", broken)


def methods(df: DataFrame) -> DataFrame:
    """Two methods per vector: all 64 dimensions, and the first 32."""
    each = F.array(
        F.struct(F.lit("full64").alias("method"), F.col("embedding").alias("e")),
        F.struct(F.lit("half32").alias("method"), F.slice("embedding", 1, 32).alias("e")),
    )
    rest = [c for c in df.columns if c != "embedding"]
    return df.select(*rest, F.inline(each)).withColumnRenamed("e", "embedding")


def predictions(df: DataFrame, *keep: str) -> DataFrame:
    """Three fixed predictors on (method, embedding) rows, as a prediction table."""

    def argmax(part: Column) -> Column:
        place = F.array_position(part, F.array_max(part))
        return F.when(place == 1, FEMALE).when(place == 2, MALE).otherwise(NEUTRAL)

    each = F.array(
        F.struct(
            F.lit("first three").alias("model"),
            F.lit(0).alias("ord"),
            argmax(F.slice("embedding", 1, 3)).alias("prediction"),
        ),
        F.struct(
            F.lit("last three").alias("model"),
            F.lit(1).alias("ord"),
            argmax(F.slice("embedding", -3, 3)).alias("prediction"),
        ),
        F.struct(
            F.lit("constant").alias("model"),
            F.lit(2).alias("ord"),
            F.lit(FEMALE).alias("prediction"),
        ),
    )
    return df.select("vec_id", "method", *keep, F.col("gender").alias("label"), F.inline(each))
