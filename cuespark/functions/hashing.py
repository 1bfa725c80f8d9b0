"""Seeded keys: the same row gets the same key in every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(key: Column, seed: int | str) -> Column:
    """32 hex digits, uniform over rows with distinct `key`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_unit(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) taken from the first 32 bits of the seeded key."""
    return F.conv(F.substring(seeded_key(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def row_key(*columns: Column) -> Column:
    """Key for rows without a natural one; equal rows share it."""
    return F.xxhash64(*columns)
