"""Running sums and neighbours in an order, without a task that takes all rows of it: rows lie in ranges, and what a range begins with is carried into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import ensure_checkpoints


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    ensure_checkpoints(df)
    return df.checkpoint()


def ranged(df: DataFrame, order: list[str], cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """df dealt out by ranges of the columns of order (ascending, nulls first), with _part, the number of a row's range, and _tie, which tells rows that tie apart.

    Rows that tie are spread over ranges too. cut writes the rows to the shared folder, so that ranges stay what they are.
    """
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    return cut(told.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows (of :func:`ranged`, by keys and then order) with the sum of each of sums over the rows of equal keys up to this one.

    A window sees the rows of one range only. The sums before a range are those of a key that began in an earlier one, one row a range at most, so they are broadcast.
    """
    named = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    own = Window.partitionBy("_part", *keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *keys).agg(*[F.sum(c).alias(n) for n, c in named.items()])
    carry = totals.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.sum(n).over(before).alias(f"_carry_{n}") for n in named])
    carry = carry.where(F.col(f"_carry_{next(iter(named))}").isNotNull())
    met = F.col("_part") == F.col("_at")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    summed = rows.withColumns({n: F.sum(c).over(own) for n, c in named.items()}).join(F.broadcast(carry), met, "left")
    return summed.withColumns({n: F.col(n) + F.coalesce(f"_carry_{n}", F.lit(0)) for n in named}).drop(*[c for c in carry.columns])


def former(rows: DataFrame, order: list[str], name: str, value: Column) -> DataFrame:
    """rows (of :func:`ranged`) with the value (not null) of the row before, over all rows; null for the first."""
    place = Window.partitionBy("_part").orderBy(*order, "_tie")
    last = rows.groupBy("_part").agg(F.max_by(value, F.struct(*order, "_tie")).alias("_last"))
    carry = last.select(F.col("_part").alias("_at"), F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("_before"))
    met = rows.withColumn(name, F.lag(value).over(place)).join(F.broadcast(carry), F.col("_part") == F.col("_at"), "left")
    return met.withColumn(name, F.coalesce(name, "_before")).drop("_at", "_before")
