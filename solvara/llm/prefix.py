"""Global offsets by a two-pass prefix sum over partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partition_starts(totals: DataFrame, part: str, total: str, start: str) -> DataFrame:
    """``(part, start)``: the sum of all earlier parts' totals.

    ``totals`` has one row per partition of a written table (its size is the number of partitions, not of rows),
    which is what makes a single ordered window and a broadcast of the result safe.
    """
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(total).over(order), F.lit(0)).cast("long").alias(start))
