"""Equi-joins that stay balanced when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.schema import require_columns

# A key is hot when it owns more than 1/_MAX_HOT of the rows: there can be at most _MAX_HOT.
_MAX_HOT = 2_000
# ... and more rows than one task should take.
_ROWS_PER_SPLIT = 500_000


def hot_keys(
    df: DataFrame,
    key: str,
    rows_per_split: int = _ROWS_PER_SPLIT,
    max_hot: int = _MAX_HOT,
) -> list[tuple[object, int]]:
    """(key, number of splits) of every hot key, at most `max_hot` of them, by an exact count.

    The count is aggregated inside the tasks first.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(rows_per_split, total // max_hot)
    found = counts.filter((F.col("n") > limit) & F.col(key).isNotNull()).collect()
    return [(r[key], -(-r["n"] // limit)) for r in found]


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    rows_per_split: int = _ROWS_PER_SPLIT,
    max_hot: int = _MAX_HOT,
) -> DataFrame:
    """Join rows that may repeat `key` to a table with one row per key.

    Rows of a hot key are spread over several tasks by a hash of `spread_by` (a row
    identifier, so a retried task repeats its choice); the matching row is copied as often.  Rows
    without a key have no partner and pass the join by.
    """
    require_columns(many, key, spread_by)
    require_columns(one, key)
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keyed = many.filter(F.col(key).isNotNull())
    joined = _joined(keyed, one, key, spread_by, how, rows_per_split, max_hot)
    if how == "inner":
        return joined
    kinds = {f.name: f.dataType for f in one.schema}
    alone = many.filter(F.col(key).isNull()).select(
        "*", *(F.lit(None).cast(kinds[c]).alias(c) for c in one.columns if c != key)
    )
    return joined.unionByName(alone)


def _joined(many, one, key, spread_by, how, rows_per_split, max_hot) -> DataFrame:
    hot = hot_keys(many, key, rows_per_split, max_hot)
    if not hot:
        return many.join(one, key, how)
    kind = many.schema[key].dataType.simpleString()
    # At most max_hot rows by construction.
    splits = F.broadcast(
        many.sparkSession.createDataFrame(hot, f"{key} {kind}, _splits bigint")
    )
    n = F.coalesce(F.col("_splits"), F.lit(1))
    spread = many.join(splits, key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), n)
    )
    copied = one.join(splits, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    )
    return spread.drop("_splits").join(copied.drop("_splits"), [key, "_part"], how).drop("_part")
