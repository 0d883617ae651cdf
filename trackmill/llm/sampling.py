"""Bounded samples that depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, turn: Column, n: int, total: int, *ties: str) -> DataFrame:
    """The n rows of df with the smallest turn (a hash from 0 to 2^32), ties by columns; total: about how many rows df has.

    Rows beyond a threshold that leaves somewhat more than n are dropped before anything is sorted, so a task passes
    on its share of them, not n.
    """
    limit = min(1.0, 1.3 * (n + 100) / max(total, 1)) * 2**32
    near = df.withColumn("__turn", turn).where(F.col("__turn") <= F.lit(int(limit)))
    return near.orderBy("__turn", *ties).limit(n).drop("__turn")
