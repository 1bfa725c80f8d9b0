"""Reports on embedding tables: norms, strategies, similarity."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions.vectors import cosine, dot, norm
from cuespark.operators.embed import pool_columns
from cuespark.operators.sampling import sample_rows
from cuespark.schema import require_columns


def norm_stats(df: DataFrame, by: str | None = None, column: str = "embedding") -> DataFrame:
    """Mean and population std of vector norms, per `by` if given."""
    measured = df.select(*([by] if by else []), norm(F.col(column)).alias("_norm"))
    return measured.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg("_norm").alias("avg_norm"),
        F.stddev_pop("_norm").alias("std_norm"),
    )


def strategy_compare(df: DataFrame, first: str, mean: str) -> DataFrame:
    """Norms of two vectors per row and the cosine between them: one row, one pass.

    Rows with a zero vector have no cosine; they are counted in `n_undefined`.
    """
    require_columns(df, first, mean)
    rows = df.select(
        norm(F.col(first)).alias("_a"),
        norm(F.col(mean)).alias("_b"),
        cosine(F.col(first), F.col(mean)).alias("_cos"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg("_a").alias("cls_avg_norm"),
        F.avg("_b").alias("mean_avg_norm"),
        F.stddev_pop("_a").alias("cls_std_norm"),
        F.stddev_pop("_b").alias("mean_std_norm"),
        F.avg("_cos").alias("avg_cosine_similarity"),
        F.stddev_pop("_cos").alias("std_cosine_similarity"),
        F.count_if(F.col("_cos").isNull()).alias("n_undefined"),
    )


def compare_strategies(
    df: DataFrame,
    text: str = "scrubbed_text",
    key: str = "post_id",
    sample_size: int | None = 100,
    seed: int = 42,
    max_tokens: int | None = None,
) -> DataFrame:
    """`strategy_compare` of both lexical poolings over a seeded sample, or over all texts."""
    rows = require_columns(df, key, text).select(key, text)
    if sample_size is not None:
        rows = sample_rows(rows, sample_size, key, seed)
    pooled = pool_columns(rows, text, {"_first": "cls", "_mean": "mean"}, max_tokens=max_tokens)
    return strategy_compare(pooled, "_first", "_mean")


def _pairs(vectors: str, n: int) -> Column:
    """The pairs among the first n elements of an array of vectors, as an array of (a, b)."""
    first = F.slice(vectors, 1, n)
    after = F.transform(
        first,
        lambda a, i: F.transform(
            F.slice(first, i + 2, F.lit(n)), lambda b: F.struct(a.alias("a"), b.alias("b"))
        ),
    )
    return F.flatten(after)


def pairwise_similarity(
    df: DataFrame, key: str = "vec_id", column: str = "embedding", n: int = 10
) -> DataFrame:
    """Cosines of the pairs among the first n vectors by key (n = 10: at most 45 pairs).

    Keys are ranked without their vectors.  The n vectors fit one row, in which the pairs are
    formed; `mean_similarity` covers the whole table without pairs.
    """
    if n > 100:
        raise ValueError("pairs are formed for at most 100 vectors; use mean_similarity")
    require_columns(df, key, column)
    first = df.select(key).orderBy(key).limit(n)
    chosen = df.select(key, column).join(F.broadcast(first), key, "left_semi")
    one_row = chosen.agg(F.array_sort(F.collect_list(F.struct(key, column))).alias("v"))
    return one_row.select(F.inline(_pairs("v", n))).select(
        F.col(f"a.{key}").alias("left_id"),
        F.col(f"b.{key}").alias("right_id"),
        cosine(F.col(f"a.{column}"), F.col(f"b.{column}")).alias("similarity"),
    )


def mean_similarity(df: DataFrame, by: str | None = None, column: str = "embedding") -> DataFrame:
    """Mean cosine over *all* pairs of a table, without forming pairs.

    For unit vectors the sum over ordered pairs is |sum|^2 - N: one pass, one vector per task.
    """
    length = norm(F.col(column))
    usable = df.filter(length > 0).select(
        *([by] if by else []),
        array_to_vector(
            F.transform(F.col(column), lambda x: F.try_divide(x.cast("double"), length))
        ).alias("_unit"),
    )
    sums = usable.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        vector_to_array(Summarizer.sum(F.col("_unit"))).alias("_s"),
    )
    n = F.col("n_vectors")
    return sums.select(
        *([by] if by else []),
        "n_vectors",
        F.try_divide(dot(F.col("_s"), F.col("_s")) - n, n * (n - 1)).alias("mean_similarity"),
    )


def similarity_spread(df: DataFrame, by: str, column: str = "embedding", rows: int = 64) -> DataFrame:
    """Mean and population std of the cosine over *all* pairs, per `by` and dimension, without pairs.

    With unit vectors u, the sum of cosines over ordered pairs is |sum u|^2 - n, and the sum of their
    squares is the squared norm of the matrix of second moments, sum u u', minus n.  Each task adds up
    its part of that matrix batch by batch and passes it on in strips of `rows` rows; strips are added
    where they meet, so that the matrix is never in one place.  Zero vectors take no part; one vector
    alone has no pairs, and NULL for both.
    """
    length = norm(F.col(column))
    usable = df.filter(length > 0).select(
        F.col(by).cast("string").alias("_by"),
        F.transform(F.col(column), lambda x: x.cast("double") / length).alias("_unit"),
    )
    kinds = pa.schema(
        [("_by", pa.string()), ("dimension", pa.int64()), ("_strip", pa.int64()), ("_n", pa.int64()),
         ("_part", pa.list_(pa.float64()))]
    )

    def moments(batches):
        sums: dict = {}
        for batch in batches:
            units = batch.column("_unit")
            keys = list(zip(batch.column("_by").to_pylist(), pc.list_value_length(units).to_pylist()))
            for key in set(keys):
                at = [i for i, k in enumerate(keys) if k == key]
                x = units.take(pa.array(at)).flatten().to_numpy().reshape(len(at), key[1])
                n, total, second = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(at), total + x.sum(0), second + x.T @ x)
        for (name, d), (n, total, second) in sums.items():
            # strip -1 is the sum of the vectors
            strips = [(-1, n, total)] + [(i, 0, second[i : i + rows].ravel()) for i in range(0, d, rows)]
            for i, own, part in strips:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((name, d, i, own, part.tolist()), kinds)],
                    schema=kinds,
                )

    parts = usable.mapInArrow(
        moments, "_by string, dimension long, _strip long, _n long, _part array<double>"
    )
    strips = parts.groupBy("_by", "dimension", "_strip").agg(
        F.sum("_n").alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("_part"))).alias("_s")
    ).withColumn("_square", dot(F.col("_s"), F.col("_s")))
    first = F.col("_strip") < 0
    totals = strips.groupBy("_by", "dimension").agg(
        F.sum("_n").alias("n_vectors"), F.sum(F.when(first, F.col("_square"))).alias("_one"),
        F.sum(F.when(~first, F.col("_square"))).alias("_two"),
    )
    n = F.col("n_vectors")
    mean = F.try_divide(F.col("_one") - n, n * (n - 1))
    square = F.try_divide(F.col("_two") - n, n * (n - 1))
    return totals.select(
        F.col("_by").alias(by), "dimension", "n_vectors", mean.alias("mean_similarity"),
        F.when(n > 1, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std_similarity"),
    )


def embedding_report(
    df: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    sample_size: int = 50,
    seed: int = 42,
    model: str = "external",
) -> DataFrame:
    """Health of an embedding table from a seeded sample: size, dimension, norms, similarity.

    Pairs are made of its ten first keys; no more vectors than these come together in a task.
    """
    sample = sample_rows(df.select(key, column), sample_size, key, seed)
    length = norm(F.col(column))
    one_row = sample.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.max(F.size(column)).cast("bigint").alias("embedding_dimension"),
        F.avg(length).alias("avg_norm"),
        F.stddev_pop(length).alias("std_norm"),
    )
    first = sample.orderBy(key).limit(10).agg(
        F.array_sort(F.collect_list(F.struct(key, column))).alias("_v")
    )
    both = one_row.unionByName(first, allowMissingColumns=True)
    one_row = both.agg(*(F.max(c).alias(c) for c in both.columns))
    stats = [c for c in one_row.columns if c != "_v"]
    pairs = one_row.select(*stats, F.inline_outer(_pairs("_v", 10)))
    similarity = cosine(F.col(f"a.{column}"), F.col(f"b.{column}"))
    return pairs.agg(
        *[F.first(c).alias(c) for c in stats],
        F.coalesce(F.avg(similarity), F.lit(0.0)).alias("avg_pairwise_similarity"),
        F.coalesce(F.stddev_pop(similarity), F.lit(0.0)).alias("std_pairwise_similarity"),
        F.lit(model).alias("model"),
    )
