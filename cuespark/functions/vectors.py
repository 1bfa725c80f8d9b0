"""Arithmetic on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def has_gap(a: Column) -> Column:
    """True if an element is NULL or NaN."""
    return F.exists(a, lambda x: x.isNull() | F.isnan(x))


def fill_gaps(a: Column) -> Column:
    """NULL and NaN become 0, infinities the largest finite doubles."""

    def filled(x: Column) -> Column:
        y = x.cast("double")
        return (
            F.when(y.isNull() | F.isnan(y), F.lit(0.0))
            .when(y == float("inf"), F.lit(MAX_DOUBLE))
            .when(y == float("-inf"), F.lit(-MAX_DOUBLE))
            .otherwise(y)
        )

    return F.transform(a, filled)


def feature_columns(df: DataFrame, marker: str = "embed_") -> list[str]:
    """Wide embedding columns, ordered by the number at their end."""

    def position(name: str) -> tuple[int, str]:
        digits = re.search(r"(\d+)$", name)
        return (int(digits.group(1)) if digits else -1, name)

    return sorted((c for c in df.columns if marker in c), key=position)


def pack(df: DataFrame, columns: list[str] | None = None, into: str = "embedding") -> DataFrame:
    """Wide columns -> one array column."""
    columns = columns or feature_columns(df)
    if not columns:
        raise ValueError(f"No embedding columns found; available columns: {df.columns}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.array(*[F.col(f"`{c}`") for c in columns]).alias(into))


def unpack(df: DataFrame, prefix: str, dim: int, column: str = "embedding") -> DataFrame:
    """Array column -> `{prefix}_embed_{i}` columns."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    parts = [F.col(column)[i].alias(f"{prefix}_embed_{i}") for i in range(dim)]
    return df.select(*rest, *parts)
