"""Rows by their place in files (J1 by position): for tables without a key, as pandas concatenates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.session import write_once


def with_position(files: DataFrame, out: str = "position") -> DataFrame:
    """Add the 0-based position of every row of a table just read from files: files by path, rows as they stand in them.

    A file may be read in several blocks by different tasks.  Each row takes its number within its task and the block it
    came from; a prefix sum over the blocks' row counts (one row per block: a few per file) places the blocks.  The
    numbered rows are written once, so that both passes see the same numbers.  An empty table stays empty.
    """
    tagged = files.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"),
                          F.monotonically_increasing_id().alias("__id"))
    tagged = write_once(tagged, "positions")
    blocks = tagged.groupBy("__path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__path", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (tagged.join(starts, ["__path", "__block"])
            .select(*files.columns, (F.col("__start") + F.col("__id") - F.col("__first")).alias(out)))


def zip_by_position(a: DataFrame, b: DataFrame, position: str = "position") -> DataFrame:
    """The columns of two file tables side by side, row by row; raises if they differ in length or share a column name."""
    shared = set(a.columns) & set(b.columns)
    if shared:
        raise ValueError(f"zip_by_position: both tables have {', '.join(sorted(shared))}")
    left, right = with_position(a, position), with_position(b, position)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"zip_by_position: {n} and {m} rows")
    return left.join(right, position)
