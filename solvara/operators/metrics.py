"""Evaluation and uncertainty calibration: A8-A11, X6, L6-L10.

Every metric is one grouped aggregate (map-side partials, one row per group) followed by a
projection, so grouping by ``split`` costs one small shuffle no matter how many rows there are.
Divisions are guarded with ``when`` so ANSI mode never raises on a constant column.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.functions.expressions import is_finite
from solvara.operators.ranking import average_rank, equal_bins


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _grouped(df: DataFrame, by):
    keys = _by(by)
    return df.groupBy(*keys) if keys else df.groupBy()


def _r2(sse: Column, sst: Column, n: Column) -> Column:
    """1 - SSE/SST; constant label: 1.0 when every error is 0, else 0.0; one row: NULL."""
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / sst))


def _pearson(cov: Column, sx: Column, sy: Column) -> Column:
    return F.when((sx == 0) | (sy == 0) | sx.isNull() | sy.isNull(), F.lit(None).cast("double")).otherwise(
        cov / (sx * sy))


def _both(label: str, pred: str) -> tuple[Column, Column]:
    """Label and prediction, each NULL unless both are present: every statistic then covers the same rows."""
    present = F.col(label).isNotNull() & F.col(pred).isNotNull()
    return F.when(present, F.col(label).cast("double")), F.when(present, F.col(pred).cast("double"))


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by="split") -> DataFrame:
    """A8 (+X1, X2): n, MAE, RMSE = sqrt(MSE), R2 per group, over rows with both values."""
    y, p = _both(label, pred)
    e = y - p
    agg = _grouped(df, by).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("_mse"),
        F.var_pop(y).alias("_var"))
    return agg.select(*_by(by), "n", "mae", F.sqrt("_mse").alias("rmse"),
                      _r2(F.col("_mse"), F.col("_var"), F.col("n")).alias("r2"))


def pearson(df: DataFrame, label: str = "label", pred: str = "pred", by="split") -> DataFrame:
    """Pearson r of label and prediction over rows with both; NULL when either side is constant."""
    y, p = _both(label, pred)
    agg = _grouped(df, by).agg(F.covar_pop(y, p).alias("_c"), F.stddev_pop(y).alias("_sx"),
                               F.stddev_pop(p).alias("_sy"))
    return agg.select(*_by(by), _pearson(F.col("_c"), F.col("_sx"), F.col("_sy")).alias("pearsonr"))


def compute_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by="split") -> DataFrame:
    """A10: mae, rmse, pearsonr, r2 in one aggregate, over rows with both values."""
    y, p = _both(label, pred)
    e = y - p
    agg = _grouped(df, by).agg(
        F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("_mse"),
        F.var_pop(y).alias("_var"), F.covar_pop(y, p).alias("_c"),
        F.stddev_pop(y).alias("_sx"), F.stddev_pop(p).alias("_sy"))
    return agg.select(*_by(by), "mae", F.sqrt("_mse").alias("rmse"),
                      _pearson(F.col("_c"), F.col("_sx"), F.col("_sy")).alias("pearsonr"),
                      _r2(F.col("_mse"), F.col("_var"), F.col("n")).alias("r2"))


def ensemble_mean(preds: DataFrame, by="row_id", pred: str = "pred", unc: str | None = "unc") -> DataFrame:
    """Mean prediction (and mean variance) over models, per row key."""
    aggs = [F.avg(pred).alias(pred)]
    if unc:
        aggs.append(F.avg(unc).alias(unc))
    return preds.groupBy(*_by(by)).agg(*aggs)


def parity_line(df: DataFrame, label: str = "label", step: float = 0.2) -> DataFrame:
    """Points min, min+step, ... below max (``arange`` semantics) for a parity view.

    The range is cut into runs of ``_LINE_RUN`` points that are dealt over the cluster before they are expanded, so
    no row holds the whole sequence; the output size is (max-min)/step by definition.
    """
    mm = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    sized = mm.select("lo", F.ceil((F.col("hi") - F.col("lo")) / F.lit(step)).cast("bigint").alias("n")).where("n > 0")
    last_run = F.floor((F.col("n") - 1) / F.lit(_LINE_RUN)).cast("bigint")
    runs = sized.select("lo", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run)).alias("run")).repartition("run")
    first = F.col("run") * F.lit(_LINE_RUN)
    pts = runs.select("lo", F.explode(F.sequence(first, F.least(first + F.lit(_LINE_RUN), F.col("n")) - 1)).alias("i"))
    return pts.select("i", (F.col("lo") + F.col("i") * F.lit(step)).alias("x"))


_LINE_RUN = 1 << 16


# ------------------------------------------------------------------ uncertainty
def _unc_ok(label: str, pred: str, unc: str) -> Column:
    return is_finite(F.col(label)) & is_finite(F.col(pred)) & is_finite(F.col(unc)) & (F.col(unc) > 0)


def fit_z_scaling(df: DataFrame, label: str = "label", pred: str = "pred", unc: str = "unc",
                  fit_on: str | None = "Validation", split_col: str = "split") -> float:
    """Z-scaling factor s^2 = mean((y - pred)^2 / unc) over usable rows of the fitting split.

    This is the closed-form optimum of the Gaussian likelihood in s^2; one aggregate, one number.
    """
    rows = df.where(_unc_ok(label, pred, unc))
    if fit_on is not None:
        rows = rows.where(F.col(split_col) == F.lit(fit_on))
    e = F.col(label) - F.col(pred)
    s2 = rows.agg(F.avg(e * e / F.col(unc))).first()[0]
    return float(s2) if s2 is not None else 1.0


def apply_z_scaling(df: DataFrame, s2: float, unc: str = "unc", out: str = "cal_unc") -> DataFrame:
    """Calibrated variance = unc * s^2."""
    return df.withColumn(out, F.col(unc) * F.lit(float(s2)))


def nll(df: DataFrame, label: str = "label", pred: str = "pred", unc: str = "unc", by="split") -> DataFrame:
    """Mean Gaussian negative log-likelihood, 0.5 ln(2 pi unc) + e^2 / (2 unc), usable rows only."""
    e = F.col(label) - F.col(pred)
    term = F.lit(0.5) * F.log(F.lit(2 * math.pi) * F.col(unc)) + e * e / (F.lit(2.0) * F.col(unc))
    return _grouped(df.where(_unc_ok(label, pred, unc)), by).agg(F.avg(term).alias("nll"))


# The 99 interval levels b/100 (b = 1..99) and their two-sided standard-normal quantiles.
CAL_LEVELS = [b / 100 for b in range(1, 100)]
CAL_Z = [NormalDist().inv_cdf((1 + p) / 2) for p in CAL_LEVELS]


def calibration_area(df: DataFrame, label: str = "label", pred: str = "pred", unc: str = "unc",
                     by="split") -> DataFrame:
    """Miscalibration area = sum_b 0.01 * |observed(b) - b/100| over 99 central intervals.

    observed(b) = share of rows with |e| <= z_b * sqrt(unc).  Every row falls into one of 100 buckets (the first
    level that holds it); a grouped count leaves at most 100 rows per group, which are then summed up.  Rows with
    unc <= 0 or non-finite values are left out and counted.
    """
    keys = _by(by)
    ok = _unc_ok(label, pred, unc)
    t = F.when(ok, F.abs(F.col(label) - F.col(pred)) / F.sqrt(F.col(unc)))
    counts = (df.select(*keys, _first_level(t).alias("_b")).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")))
    n_at = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda b: F.coalesce(F.try_element_at(F.col("_m"), b), F.lit(0)))
    agg = (counts.groupBy(*keys) if keys else counts.groupBy()).agg(
        F.sum(F.when(F.col("_b").isNotNull(), F.col("_c")).otherwise(0)).alias("_n"),
        F.sum(F.when(F.col("_b").isNull(), F.col("_c")).otherwise(0)).alias("n_rejected"),
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_c")))).alias("_m"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("area"), F.lit(1).alias("b"))

    def step(acc, c):
        seen = acc["seen"] + c
        gap = F.abs(seen / F.col("_n").cast("double") - acc["b"] / F.lit(100))
        return F.struct(seen.alias("seen"), (acc["area"] + F.lit(0.01) * gap).alias("area"), (acc["b"] + 1).alias("b"))

    area = F.aggregate(n_at, start, step, lambda acc: acc["area"])
    return agg.select(*keys, F.when(F.col("_n") > 0, area).alias("cal_area"), F.col("n_rejected").cast("bigint"))


def _first_level(t: Column) -> Column:
    """Smallest b in 1..99 with t <= z_b, 100 beyond the last; NULL for NULL.

    A logistic approximation of the normal distribution is off by far less than one level, so the guess is put
    right by comparing with the two quantiles next to it.
    """
    z = F.array(*[F.lit(x) for x in [0.0, *CAL_Z, float("inf")]])
    small = F.least(t, F.lit(6.0))
    share = F.lit(2.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * small + F.lit(0.07056) * small * small * small))) - F.lit(1.0)
    guess = F.greatest(F.lit(1), F.least(F.lit(100), F.ceil(share * F.lit(100.0)).cast("int")))
    below, at = F.element_at(z, guess), F.element_at(z, guess + 1)  # z_(guess - 1) and z_guess
    level = F.when(t <= below, guess - 1).when(t <= at, guess).otherwise(guess + 1)
    return F.when(t.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(100), level)))


def ence(df: DataFrame, label: str = "label", pred: str = "pred", unc: str = "unc",
         n_bins: int = 100, id_col: str = "row_id") -> DataFrame:
    """Expected normalized calibration error over equal-count bins along (unc, id).

    Per bin rmv = sqrt(mean unc), rmse = sqrt(mean e^2); result = mean over bins of |rmv - rmse| / rmv.
    """
    rows = df.where(_unc_ok(label, pred, unc)).select(id_col, label, pred, unc)
    binned = equal_bins(rows, [unc, id_col], n_bins, "bin")
    e = F.col(label) - F.col(pred)
    per_bin = binned.groupBy("bin").agg(F.sqrt(F.avg(unc)).alias("rmv"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return per_bin.agg(F.avg(F.abs(F.col("rmv") - F.col("rmse")) / F.col("rmv")).alias("ence"),
                       F.count(F.lit(1)).alias("n_bins"))


def spearman(df: DataFrame, a: str, b: str, id_col: str = "row_id") -> DataFrame:
    """Spearman rho = Pearson r of average ranks (ties share the mean position); NULL if constant."""
    ra = average_rank(df.select(id_col, a), a, id_col, "_ra").select(id_col, "_ra")
    rb = average_rank(df.select(id_col, b), b, id_col, "_rb").select(id_col, "_rb")
    both = ra.join(rb, id_col, "inner")
    agg = both.agg(F.covar_pop("_ra", "_rb").alias("_c"), F.stddev_pop("_ra").alias("_sx"),
                   F.stddev_pop("_rb").alias("_sy"))
    return agg.select(_pearson(F.col("_c"), F.col("_sx"), F.col("_sy")).alias("spearman"))


def uncertainty_error_spearman(df: DataFrame, label: str = "label", pred: str = "pred", unc: str = "unc",
                               id_col: str = "row_id") -> DataFrame:
    """L10 as the reference uses it: rank correlation of the uncertainty with the absolute error."""
    rows = df.where(_unc_ok(label, pred, unc)).select(
        id_col, F.col(unc).alias("_u"), F.abs(F.col(label) - F.col(pred)).alias("_ae"))
    return spearman(rows, "_u", "_ae", id_col)
