"""Seeded samples, stratified splits and folds.

Rows are ordered by a seeded hash of their key.  A sample, split or fold is then a range of
that order, and a range is described by the hash at its end.  Finding these few *cut* hashes
reads two narrow columns; applying them is a map-side comparison.  No wide row is shuffled or
ranked, and no window runs over a whole label.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.hashing import seeded_key, seeded_unit
from cuespark.schema import require_columns

# A hash bucket with more rows than this is divided again before its rows are ranked.
_RANK_ROWS = 100_000
# Default bound of classes: counts and cuts are driver-side reports with one row per class.
MAX_CLASSES = 100_000


def sample_rows(df: DataFrame, n: int, key: str = "post_id", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the first in the order of (hash of the key, hash of the row).

    The same for every n: all rows below the n-th smallest hash are a filter, without shuffle or
    sort; of the rows that have just this hash, one if keys identify rows, the first are added.
    Rows that are equal in every column are interchangeable.
    """
    require_columns(df, key)
    hashed = seeded_key(F.col(key), seed)
    narrow = df.select(F.lit("").alias("_s"), hashed.alias("_h"))
    open_ends = _close_in(narrow, [("", n)])
    if not open_ends:  # no n-th row: all rows are the sample
        return df
    cut = _rank(narrow, open_ends)[("", n)]
    below = narrow.filter(F.col("_h") < cut).count()
    at_cut = df.filter(hashed == cut)
    row = F.xxhash64(*(F.to_json(F.struct(c)) if "map" in t else F.col(c) for c, t in df.dtypes))
    return df.filter(hashed < cut).unionByName(at_cut.orderBy(row).limit(n - below))


def sample_fraction(
    df: DataFrame, fraction: float, key: str = "post_id", seed: int = 39
) -> DataFrame:
    """A stable share of the rows: a filter, no shuffle."""
    return require_columns(df, key).filter(seeded_unit(F.col(key), seed) < fraction)


def class_counts(df: DataFrame, label: str, most: int = MAX_CLASSES) -> dict[str, int]:
    """Rows per class, in label order; ValueError beyond `most` classes."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"'{label}' has more than {most} values; it is not a class label")
    if any(r[label] is None for r in rows):
        raise ValueError(f"'{label}' has missing values; drop or fill them first")
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def train_quotas(counts: dict[str, int], test_size: float) -> dict[str, int]:
    """Training rows per class: proportional shares, largest remainders first, ties by label."""
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    n_train = total - n_test
    if counts and min(counts.values()) < 2:
        raise ValueError("every class needs at least 2 rows for a stratified split")
    if n_train < len(counts) or n_test < len(counts):
        raise ValueError("both sides of a stratified split need at least one row per class")
    quotas = {c: n * n_train // total for c, n in counts.items()}
    by_remainder = sorted(counts, key=lambda c: -(counts[c] * n_train % total))
    for c in by_remainder[: n_train - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def stratified_split(
    df: DataFrame,
    label: str = "gender",
    key: str = "vec_id",
    test_size: float = 0.2,
    seed: int | str = 42,
    into: str = "split",
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """Add `split` = 'train' or 'test' with exact per-class quotas.

    `key` must identify rows; `counts` saves a pass if the class counts are known.
    """
    require_columns(df, label, key)
    counts = counts or class_counts(df, label)
    quotas = train_quotas(counts, test_size)
    ends = {c: [counts[c] - quotas[c]] for c in counts}
    return _by_segment(df, label, key, seed, ends, "_segment").select(
        *df.columns, F.when(F.col("_segment") == 0, "test").otherwise("train").alias(into)
    )


def fold_sizes(counts: dict[str, int], k: int) -> dict[str, list[int]]:
    """Rows of each class in each fold: label-sorted rows dealt to the folds in turn."""
    if k < 2:
        raise ValueError("at least 2 folds are needed")
    if counts and max(counts.values()) < k:
        raise ValueError(f"no class has {k} rows")
    sizes, start = {}, 0
    for c, n in counts.items():
        # Positions p with start <= p < start + n and p % k == fold.
        sizes[c] = [(start + n - f + k - 1) // k - (start - f + k - 1) // k for f in range(k)]
        start += n
    return sizes


def stratified_folds(
    df: DataFrame,
    label: str = "gender",
    key: str = "vec_id",
    k: int = 5,
    seed: int | str = 42,
    into: str = "fold",
) -> DataFrame:
    """Add `fold` in 0..k-1: consecutive stretches of each class's hash order."""
    require_columns(df, label, key)
    sizes = fold_sizes(class_counts(df, label), k)
    ends = {c: [sum(s[: i + 1]) for i in range(k - 1)] for c, s in sizes.items()}
    return _by_segment(df, label, key, seed, ends, into)


def _by_segment(
    df: DataFrame, label: str, key: str, seed: int | str, ends: dict, into: str
) -> DataFrame:
    """Number the stretches of each class's hash order that end at the given ranks."""
    hashed = seeded_key(F.col(key), seed)
    narrow = df.select(F.col(label).alias("_s"), hashed.alias("_h"))
    cuts = _cut_hashes(narrow, ends)
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        [(c, [cuts[(c, r)] for r in ranks]) for c, ranks in ends.items()],
        f"_s {kind}, _cuts array<string>",
    )
    # One row per class, at most MAX_CLASSES of them.
    joined = df.withColumn("_h", hashed).join(
        F.broadcast(table), F.col(label) == F.col("_s"), "left"
    )
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_h")))
    return joined.withColumn(into, passed).drop("_h", "_s", "_cuts")


def _cut_hashes(narrow: DataFrame, ends: dict) -> dict:
    """(stratum, rank) -> the rank-th smallest `_h` of the stratum ('' for rank 0)."""
    wanted = [(s, r) for s, ranks in ends.items() for r in set(ranks) if r > 0]
    found = {(s, 0): "" for s in ends}
    found.update(_rank(narrow, _close_in(narrow, wanted)))
    return found


def _close_in(narrow: DataFrame, wanted: list) -> list:
    """Find the hash bucket of every (stratum, rank).

    `narrow` has the columns `_s` and `_h`.  Buckets are told by leading hex digits, three at a
    time, until they are small enough to rank.  Returns (stratum, rank, bucket, rank inside the
    bucket); a rank beyond the rows of its stratum is left out.
    """
    spark = narrow.sparkSession
    kind = narrow.schema["_s"].dataType.simpleString()
    open_ends = [(s, r, "", r) for s, r in wanted]
    digits, biggest = 0, None
    while open_ends and (biggest is None or biggest > _RANK_ROWS) and digits < 32:
        rows = _within(spark, narrow, open_ends, kind, digits)
        # The partial aggregation shrinks every task to at most 4096 rows per open bucket.
        counts = rows.groupBy("_s", "_b", F.substring("_h", digits + 1, 3).alias("_d")).agg(
            F.count(F.lit(1)).alias("n")
        )
        order = Window.partitionBy("_s", "_b").orderBy("_d")  # at most 4096 rows
        reached = counts.withColumn("_upto", F.sum("n").over(order))
        targets = _targets(spark, open_ends, kind)
        inside = (F.col("r") > F.col("_upto") - F.col("n")) & (F.col("r") <= F.col("_upto"))
        hits = reached.join(targets, ["_s", "_b"]).filter(inside).collect()  # one row per cut
        biggest = max((h["n"] for h in hits), default=0)
        open_ends = [
            (h["_s"], h["rank"], h["_b"] + h["_d"], h["r"] - h["_upto"] + h["n"]) for h in hits
        ]
        digits += 3
    return open_ends


def _rank(narrow: DataFrame, open_ends: list) -> dict:
    """(stratum, rank) -> hash, by ranking the rows of the buckets found."""
    if not open_ends:
        return {}
    digits = len(open_ends[0][2])
    if digits >= 32:  # whole hashes: copies of one key, nothing to rank
        return {(s, rank): bucket for s, rank, bucket, _ in open_ends}
    spark = narrow.sparkSession
    kind = narrow.schema["_s"].dataType.simpleString()
    rows = _within(spark, narrow, open_ends, kind, digits)
    order = Window.partitionBy("_s", "_b").orderBy("_h")  # about _RANK_ROWS at most
    ranked = rows.withColumn("r", F.row_number().over(order))
    hits = ranked.join(_targets(spark, open_ends, kind), ["_s", "_b", "r"]).collect()
    return {(h["_s"], h["rank"]): h["_h"] for h in hits}


def _targets(spark, open_ends: list, kind: str) -> DataFrame:
    rows = [(s, b, r, rank) for s, rank, b, r in open_ends]
    return F.broadcast(spark.createDataFrame(rows, f"_s {kind}, _b string, r bigint, rank bigint"))


def _within(spark, narrow: DataFrame, open_ends: list, kind: str, digits: int) -> DataFrame:
    """Rows in the buckets that hold an open end; there is one bucket per cut at most."""
    buckets = {(s, b) for s, _, b, _ in open_ends}
    table = spark.createDataFrame(sorted(buckets), f"_s {kind}, _b string")
    rows = narrow.withColumn("_b", F.substring("_h", 1, digits))
    return rows.join(F.broadcast(table), ["_s", "_b"], "left_semi")
