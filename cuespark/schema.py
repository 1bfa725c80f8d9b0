"""Column names, label domain and explicit schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FEMALE, MALE, NEUTRAL = "FEMALE", "MALE", "NEUTRAL"
LABELS = (FEMALE, MALE, NEUTRAL)

POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("female_pred", T.DoubleType()),
    ]
)

# One answer of a text backend.  `error` is set when the call itself failed.
RESPONSES = T.StructType(
    [
        T.StructField("request_hash", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

EMBEDDED = T.StructType(
    [
        T.StructField("request_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise ValueError naming the missing column and the ones that exist."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found; available columns: {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """Raise ValueError if nothing is left after filtering (stops at the first row found)."""
    if df.isEmpty():
        raise ValueError(f"No valid {what} left after filtering")
    return df
