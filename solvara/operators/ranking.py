"""Global ranks without a single-partition window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  Instead the rows are
range-partitioned and sorted once (``orderBy``), each row takes its position inside its partition
from ``monotonically_increasing_id`` (partition index in the upper bits), the result is written as
parquet to the shared folder so both passes see the same ids, and per-partition row counts (one row per
partition, a bound set by the shuffle width) give each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.session import write_once

_POS_BITS = 33  # monotonically_increasing_id = partition_index << 33 | position


def _as_cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_rank(df: DataFrame, order, rank_col: str = "rank", keep=None) -> DataFrame:
    """Add ``rank_col`` = 0-based position of each row under ``order``.

    ``order`` must be a total order (end it with a unique key) for the result to be deterministic.  Only the
    columns in ``keep`` (default: all) are written after the sort.
    Plan: one range exchange + sort, one parquet write, one tiny aggregate of per-partition counts.
    """
    keep = list(keep) if keep is not None else df.columns
    tagged = df.orderBy(*_as_cols(order)).withColumn("_mid", F.monotonically_increasing_id()).select(*keep, "_mid")
    tagged = write_once(tagged, "rank")
    pid = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    # one row per non-empty partition: bounded by the shuffle width, not by the data
    counts = sorted(tagged.groupBy(pid.alias("p")).count().collect())
    offsets, running = [], 0
    for p, n in counts:
        offsets.append((p, running))
        running += n
    table = df.sparkSession.createDataFrame(offsets, "_pid bigint, _off bigint")
    joined = tagged.withColumn("_pid", pid).join(F.broadcast(table), "_pid", "inner")
    return joined.select(*keep, (F.col("_off") + pos).cast("bigint").alias(rank_col))


def ntile_expr(rank: Column, n_rows: int, n_tiles: int) -> Column:
    """Closed-form SQL ``NTILE(n_tiles)`` (1-based) for a 0-based rank among ``n_rows`` rows.

    The first ``n_rows mod n_tiles`` tiles hold one extra row, exactly as NTILE assigns them.
    """
    base, rem = divmod(n_rows, n_tiles)
    cut = rem * (base + 1)
    first = F.floor(rank / F.lit(base + 1))
    rest = F.lit(rem) + F.floor((rank - F.lit(cut)) / F.lit(max(base, 1)))
    return (F.when(rank < F.lit(cut), first).otherwise(rest) + F.lit(1)).cast("bigint")


def equal_bins(df: DataFrame, order, n_bins: int, bin_col: str = "bin") -> DataFrame:
    """Equal-count bins (``NTILE(min(n_bins, N))``) along a total order."""
    ranked = global_rank(df, order, "_r")
    n = ranked.count()
    tiles = max(1, min(n_bins, n))
    return ranked.withColumn(bin_col, ntile_expr(F.col("_r"), n, tiles)).drop("_r")


def average_rank(df: DataFrame, value_col: str, key_col: str = "row_id",
                 rank_col: str = "avg_rank") -> DataFrame:
    """1-based rank of ``value_col`` with ties given the average of their positions.

    Tie groups are contiguous under ``(value, key)``, so the first position of a group is the
    minimum rank inside it; an aggregate per value (pre-aggregated map-side, so a value shared by a
    third of the rows costs one partial row per task) is written once and brought back by an equi-join.
    Its size is then known to Spark, which broadcasts it if small and splits a skewed join otherwise.
    NULL and NaN values have no rank (NULL) and do not count for the others.
    """
    value = F.col(value_col)
    has_rank = value.isNotNull() & ~F.isnan(value.cast("double"))
    ranked = global_rank(df.where(has_rank), [value_col, key_col], "_r")
    groups = write_once(ranked.groupBy(F.col(value_col).alias("_v")).agg(F.min("_r").alias("_lo"), F.count("*").alias("_cnt")), "ties")
    avg = F.col("_lo") + (F.col("_cnt") + F.lit(1)) / F.lit(2.0)
    got = ranked.join(groups, ranked[value_col] == groups["_v"], "inner").select(*df.columns, avg.cast("double").alias(rank_col))
    return got.unionByName(df.where(~has_rank).withColumn(rank_col, F.lit(None).cast("double")))
