"""Labelling and scrubbing posts as they arrive.

The stream's checkpoint replaces progress files: a restarted query goes on behind the last
committed batch, and the file sink makes every batch visible exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuespark.operators.filters import drop_blank_text
from cuespark.operators.label import label_posts
from cuespark.operators.scrub import scrub_posts


def post_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """Parquet files arriving below `path`; with `pattern`, files of that name or in folders of it."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    # in braces even a plain name is a glob, which may be a file or a folder
    return reader.parquet(f"{path}/{{{pattern}}}" if pattern else path)


def label_and_scrub(
    posts: DataFrame,
    text: str = "raw_text",
    key: str = "post_id",
    event_time: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Stateless labelling and scrubbing.

    With an event time, posts delivered again within `delay` are dropped; the watermark bounds
    the state that needs.
    """
    kept = drop_blank_text(posts, text)
    if event_time:
        kept = kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return scrub_posts(label_posts(kept, text), text)


def run_to_parquet(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it to `sink`, and stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )


def run_label_counts(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Running label counts: state of one row per label, one folder of `sink` per batch.

    A batch that runs again after a failure replaces its own folder.
    """

    def keep(counts: DataFrame, batch: int) -> None:
        counts.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return (
        stream.groupBy("gender")
        .count()
        .writeStream.foreachBatch(keep)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(gender, count) as of the last batch."""
    counts = spark.read.parquet(sink)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.filter(F.col("batch") == last).drop("batch")


def label_changes(
    posts: DataFrame, text: str = "raw_text", key: str = "post_id", revision: str = "revision"
) -> DataFrame:
    """(gender, change) of a stream of revisions: what every batch adds to or takes from a label.

    The state of a post is its latest revision and that revision's label.  A later revision takes the
    old label back and adds its own; one without text withdraws the post; one that is not later than
    the state's, delivered late or twice, changes nothing.  Of equal revisions in one batch the text
    that comes first in binary order counts.  Labels are made before the state, natively, so that no
    text is kept or shipped.
    """
    kept = posts.withColumn(text, F.when(F.col(text).rlike(r"(?U)\S"), F.col(text)))
    labelled = label_posts(kept, text).select(
        F.col(key).cast("string").alias("_key"), F.col(revision).cast("long").alias("_revision"),
        F.when(F.col(text).isNotNull(), F.col("gender")).alias("_gender"), F.md5(text).alias("_text"),
    )

    def update(
        group: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        at, old = state.get if state.exists else (None, None)
        latest, tie, new = at, None, old
        for part in parts:
            for r, gender, tied in zip(part["_revision"], part["_gender"], part["_text"].fillna("")):
                if pd.isna(r) or (at is not None and r <= at):
                    continue
                if latest is None or r > latest or (r == latest and tie is not None and tied < tie):
                    latest, tie, new = int(r), tied, None if pd.isna(gender) else gender
        if latest != at:
            state.update((latest, new))
            if new != old:
                rows = [(old, -1)] * (old is not None) + [(new, 1)] * (new is not None)
                yield pd.DataFrame(rows, columns=["gender", "change"])

    return labelled.groupBy("_key").applyInPandasWithState(
        update, "gender string, change long", "revision long, gender string", "append",
        GroupStateTimeout.NoTimeout,
    )


def run_label_changes(changes: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's changes, summed per label, to `sink`: one folder per batch.

    A batch that runs again after a failure replaces its own folder.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        summed = rows.groupBy("gender").agg(F.sum("change").alias("change"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return (
        changes.writeStream.foreachBatch(keep)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(gender, count) of the posts as they are after the last batch; labels without posts are left out."""
    sums = spark.read.parquet(sink).groupBy("gender").agg(F.sum("change").alias("count"))
    return sums.filter("count <> 0")
