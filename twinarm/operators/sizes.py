"""Broadcast hints behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table is broadcast up to so many rows, and so many characters in its text column if it has one.
ROWS, CHARACTERS = 200_000, 1 << 26


def is_small(df: DataFrame, text: str | None = None, rows: int = ROWS, characters: int = CHARACTERS) -> bool:
    """Whether a table may be broadcast."""
    measure = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(text) if text else F.lit(0)).alias("c")).first()
    return measure["n"] <= rows and (measure["c"] or 0) <= characters


def near(df: DataFrame, text: str | None = None) -> DataFrame:
    """df with a broadcast hint if it is small; as it is otherwise, to be joined by shuffle."""
    return F.broadcast(df) if is_small(df, text) else df
