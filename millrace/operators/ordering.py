"""Operators that depend on an order: first wins, last wins, caps, ranks. The order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. One grouped minimum, partly computed before the shuffle, instead of a window."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    names = [f"_k{i}" for i in range(len(key))]
    return df.groupBy(*[k.alias(n) for k, n in zip(key, names)]).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    names = [f"_k{i}" for i in range(len(key))]
    return df.groupBy(*[k.alias(n) for k, n in zip(key, names)]).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; the planner limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def argmax(df: DataFrame, group: list[str], value: Column, order: Column, columns: list[str]) -> DataFrame:
    """columns of the row with the greatest value of each group, of equals the first in order."""
    row = F.struct(*columns)
    best = df.groupBy(*group).agg(F.min_by(row, F.struct(-value, order)).alias("_best"))
    return best.select(*group, *[F.col(f"_best.{c}").alias(c) for c in columns])
