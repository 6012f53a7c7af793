"""Descriptor preparation: correlation, correlated-column drop, scalers.

Each scaler is fitted with ONE aggregate over the rows (one number per column, map-side partials),
brought back as a single row and applied as a projection with literals -- no join, no second shuffle.
NaN counts as missing everywhere, like NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.session import ship_package

#: Columns per block of the co-moment matrices, and groups in which the blocks of all tasks are first added up.
_BLOCK, _GROUPS = 64, 64
#: A variance below this share of the mean square is rounding, not variation.
_ROUNDING = 1e-13


def _fit_rows(df: DataFrame, fit_on: str | Column | None) -> DataFrame:
    if fit_on is None:
        return df
    return df.where(F.expr(fit_on) if isinstance(fit_on, str) else fit_on)


def present(c: str | Column) -> Column:
    """The value as a double; NaN counts as missing, like NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def co_moments(df: DataFrame, cols) -> dict[str, np.ndarray]:
    """Per pair of columns, over the rows where both are present: counts ``n``, sums ``s`` (of the row's column) and ``q`` of
    squares, and sums of products ``p``, of the values less one value of the column (matrices of columns x columns).

    One pass for any width: every task adds up its rows in blocks of 64 x 64 column pairs with four matrix products and
    writes each block once; the blocks of all tasks are added up by Spark in two steps.  What reaches the driver is
    bounded by the columns.
    """
    ship_package(df.sparkSession)
    cols, k = list(cols), len(list(cols))
    x = [present(c) for c in cols]
    few = df.select(*[v.alias(f"c{i}") for i, v in enumerate(x)]).limit(100)  # any value near the data will do
    start = few.agg(*[F.first(f"c{i}", ignorenulls=True) for i in range(k)]).first()
    shift = np.array([0.0 if v is None or not math.isfinite(v) else v for v in start], dtype="f8")
    bounds = [(i, min(i + _BLOCK, k)) for i in range(0, k, _BLOCK)]
    pairs = [(i, j) for i in range(len(bounds)) for j in range(len(bounds))]

    def run(batches):
        total = {b: 0.0 for b in pairs}
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, k) - shift
            here = ~np.isnan(v)
            v = np.where(here, v, 0.0)
            here = here.astype("f8")
            for i, j in pairs:
                (a, z), (c, y) = bounds[i], bounds[j]
                with np.errstate(invalid="ignore", over="ignore"):
                    total[i, j] = total[i, j] + np.stack([here[:, a:z].T @ here[:, c:y], v[:, a:z].T @ here[:, c:y],
                                                          (v[:, a:z] ** 2).T @ here[:, c:y], v[:, a:z].T @ v[:, c:y]])
        done = [(at, t.ravel().tolist()) for at, t in enumerate(total.values()) if not np.isscalar(t)]
        yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in done], pa.int32()), pa.array([t for _, t in done], pa.list_(pa.float64()))],
                                         names=["block", "sums"])

    blocks = df.select(F.array(*x).alias("v")).mapInArrow(run, "block int, sums array<double>")
    vectors = blocks.select("block", (F.spark_partition_id() % _GROUPS).alias("g"), array_to_vector("sums").alias("sums"))
    part = vectors.groupBy("block", "g").agg(Summarizer.sum(F.col("sums")).alias("sums"))
    found = part.groupBy("block").agg(Summarizer.sum(F.col("sums")).alias("sums")).collect()
    out = {name: np.zeros((k, k)) for name in "nsqp"}
    for r in found:
        (a, z), (c, y) = (bounds[i] for i in pairs[r["block"]])
        for name, m in zip("nsqp", r["sums"].toArray().reshape(4, z - a, y - c)):
            out[name][a:z, c:y] = m
    return out


def corr_matrix(df: DataFrame, cols) -> dict[tuple[str, str], float | None]:
    """Pearson r for every pair i < j of ``cols`` over the rows where both are present; NULL and NaN are missing.

    None when a column is constant over those rows, when it holds an infinite value there, or when there are no rows.
    All pairs come from one pass over the rows (:func:`co_moments`).
    """
    cols = list(cols)
    if len(cols) < 2:
        return {}
    m = co_moments(df, cols)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        n = m["n"]
        spread = m["q"] - m["s"] ** 2 / n      # of the row's column over the rows that both have
        spread = np.where(spread > _ROUNDING * m["q"], spread, np.nan)
        r = (m["p"] - m["s"] * m["s"].T / n) / np.sqrt(spread * spread.T)
    r = np.clip(r, -1.0, 1.0)
    return {(a, b): None if math.isnan(r[i, j]) else float(r[i, j])
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j}


def abs_corr(df: DataFrame, cols) -> DataFrame:
    """A2 (+X2): long table ``(col_i, col_j, r)`` of |Pearson r| for i < j, in column order."""
    spark = df.sparkSession
    pairs = corr_matrix(df, cols)
    rows = [(a, b, None if r is None else abs(r)) for (a, b), r in pairs.items()]
    return spark.createDataFrame(rows, "col_i string, col_j string, r double")


def correlated_columns(pairs: dict[tuple[str, str], float | None], cols, threshold: float = 0.7) -> list[str]:
    """Columns j such that some earlier column i has |r_ij| > threshold (strict; undefined r never counts).

    Not greedy: column i counts even when it is itself dropped -- the reference's upper-triangle rule.
    """
    cols = list(cols)
    dropped = []
    for j in range(len(cols)):
        for i in range(j):
            r = pairs.get((cols[i], cols[j]))
            if r is not None and not math.isnan(r) and abs(r) > threshold:
                dropped.append(cols[j])
                break
    return dropped


def drop_correlated(df: DataFrame, cols, threshold: float = 0.7,
                    fit_on: str | Column | None = None) -> tuple[DataFrame, list[str]]:
    """A3: drop every column that correlates above ``threshold`` with an earlier one."""
    pairs = corr_matrix(_fit_rows(df, fit_on), cols)
    dropped = correlated_columns(pairs, cols, threshold)
    return df.drop(*dropped), dropped


@dataclass
class ColumnScaler:
    """Fitted per-column center and divisor; ``apply`` is a projection with literals."""

    center: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - F.lit(self.center[c])) / F.lit(self.scale[c]) for c in self.center})

    def invert(self, df: DataFrame, scaled_col: str, out_col: str, name: str) -> DataFrame:
        """Map ``scaled_col`` back to the units of fitted column ``name``: z * scale + center."""
        return df.withColumn(out_col, F.col(scaled_col) * F.lit(self.scale[name]) + F.lit(self.center[name]))


def fit_standardizer(df: DataFrame, cols, fit_on=None) -> ColumnScaler:
    """A4 fit: mean and population std per column over its present values; a zero (or undefined) std divides by 1."""
    cols = list(cols)
    row = _fit_rows(df, fit_on).agg(*[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                                    *[F.stddev_pop(present(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    center = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
    scale = {c: (float(row[f"s{i}"]) if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
    return ColumnScaler(center, scale)


def standardize(df: DataFrame, cols, fit_on=None) -> DataFrame:
    """A4: (x - mean) / population std, in place; a missing value (NULL or NaN) stays what it is."""
    return fit_standardizer(df, cols, fit_on).apply(df)


def fit_block_scaler(df: DataFrame, cols, fit_on=None) -> ColumnScaler:
    """A5 fit: per-column mean; one shared divisor sqrt(sum of column population variances)."""
    cols = list(cols)
    row = _fit_rows(df, fit_on).agg(*[F.avg(present(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                                    *[F.var_pop(present(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    total = math.sqrt(sum(float(row[f"v{i}"] or 0.0) for i in range(len(cols))))
    div = total if total > 0 else 1.0
    return ColumnScaler({c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)}, {c: div for c in cols})


def standardize_block(df: DataFrame, cols, fit_on=None) -> DataFrame:
    """A5: center each column, divide the whole block by one number."""
    return fit_block_scaler(df, cols, fit_on).apply(df)


def preprocess(df: DataFrame, blocks=(), columns=(), fit_on=None) -> DataFrame:
    """Block-scale each block, standardize the listed columns, pass every other column through.

    All statistics come from one aggregate over the fitting rows.
    """
    blocks = [list(b) for b in blocks]
    columns = list(columns)
    every = [c for b in blocks for c in b] + columns
    rows = _fit_rows(df, fit_on)
    row = rows.agg(*[F.avg(present(c)).alias(f"m_{c}") for c in every],
                   *[F.var_pop(present(c)).alias(f"v_{c}") for c in every]).first()
    center = {c: float(row[f"m_{c}"] or 0.0) for c in every}
    scale = {}
    for b in blocks:
        total = math.sqrt(sum(float(row[f"v_{c}"] or 0.0) for c in b))
        for c in b:
            scale[c] = total if total > 0 else 1.0
    for c in columns:
        sd = math.sqrt(float(row[f"v_{c}"] or 0.0))
        scale[c] = sd if sd > 0 else 1.0
    return ColumnScaler(center, scale).apply(df)


def fit_target_scaler(df: DataFrame, y: str, fit_on="split = 'Training'") -> ColumnScaler:
    """Target normalization fitted on the training rows (mean, population std)."""
    return fit_standardizer(df, [y], fit_on)


def minmax_scale(df: DataFrame, cols, fit_on=None) -> DataFrame:
    """(x - min) / (max - min) over the present values; a constant column maps to 0, a missing value stays."""
    cols = list(cols)
    row = _fit_rows(df, fit_on).agg(*[F.min(present(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                                    *[F.max(present(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None or hi is None or hi == lo:
            out[c] = F.when(present(c).isNotNull(), F.lit(0.0)).otherwise(F.col(c).cast("double"))
        else:
            out[c] = (F.col(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return df.withColumns(out)
