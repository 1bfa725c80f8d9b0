"""Row filters and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.functions.text import is_blank
from cuespark.schema import FEMALE, MALE, NEUTRAL, require_columns


def drop_missing_text(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return require_columns(df, text).na.drop(subset=[text])


def drop_blank_text(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Drop missing and blank texts; the NULL test comes first so that it reaches the scan."""
    return drop_missing_text(df, text).filter(~is_blank(F.col(text)))


def keep_gender(df: DataFrame, gender: str | None, column: str = "gender") -> DataFrame:
    """Rows of one label; no filter if none is asked for or the table has no labels."""
    if not gender or column not in df.columns:
        return df
    return df.filter(F.col(column) == gender)


def binary_only(df: DataFrame, column: str = "gender") -> DataFrame:
    """Drop NEUTRAL; a missing label is not NEUTRAL and stays."""
    return require_columns(df, column).filter(~F.col(column).eqNullSafe(NEUTRAL))


def decode_label(df: DataFrame, column: str = "female_pred", into: str = "gender") -> DataFrame:
    """0.0 -> MALE, 1.0 -> FEMALE; rows without a usable number are dropped."""
    value = F.col(column)
    return (
        require_columns(df, column)
        .filter(value.isin(0.0, 1.0))
        .withColumn(into, F.when(value == 1.0, FEMALE).otherwise(MALE))
    )


def head(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The first n rows by the given columns; every task hands on n rows at most."""
    return require_columns(df, *by).orderBy(*by).limit(n)
