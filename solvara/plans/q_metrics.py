"""Registered queries: evaluation, ranks and uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from solvara.operators import metrics as m
from solvara.operators import ranking
from solvara.plans import fixtures as fx
from solvara.plans.registry import register

PRED = f"({fx.FX_PRED_SQL})"
UNC = f"({fx.FX_UNC_SQL})"
OK = "(unc > 0 AND NOT isnan(unc) AND NOT isinf(unc) AND NOT isnan(label) AND NOT isnan(pred))"


def _r(c, k=6):
    return F.round(F.col(c), k).alias(c)


R2_SQL = ("CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(label) = 0 THEN "
          "CASE WHEN avg((label - pred) * (label - pred)) = 0 THEN 1.0 ELSE 0.0 END "
          "ELSE 1 - avg((label - pred) * (label - pred)) / var_pop(label) END")
PEARSON_SQL = ("CASE WHEN stddev_pop(label) = 0 OR stddev_pop(pred) = 0 THEN NULL "
               "ELSE covar_pop(label, pred) / (stddev_pop(label) * stddev_pop(pred)) END")


@register("a8_regression_metrics",
          f"SELECT split, count(*) AS n, 0.0 + round(avg(abs(label - pred)), 4) AS mae, "
          f"0.0 + round(sqrt(avg((label - pred) * (label - pred))), 4) AS rmse, 0.0 + round({R2_SQL}, 6) AS r2 "
          f"FROM {PRED} p GROUP BY split")
def a8_regression_metrics(spark, sf_dir):
    r = m.regression_metrics(fx.fx_pred(spark, sf_dir), "label", "pred", "split")
    return r.select("split", "n", _r("mae", 4), _r("rmse", 4), _r("r2"))


@register("a9_pearson", f"SELECT split, 0.0 + round({PEARSON_SQL}, 6) AS pearsonr FROM {PRED} p GROUP BY split")
def a9_pearson(spark, sf_dir):
    return m.pearson(fx.fx_pred(spark, sf_dir)).select("split", _r("pearsonr"))


@register("a10_compute_metrics",
          f"SELECT split, 0.0 + round(avg(abs(label - pred)), 4) AS mae, "
          f"0.0 + round(sqrt(avg((label - pred) * (label - pred))), 4) AS rmse, 0.0 + round({PEARSON_SQL}, 6) AS pearsonr, "
          f"0.0 + round({R2_SQL}, 6) AS r2 FROM {PRED} p GROUP BY split")
def a10_compute_metrics(spark, sf_dir):
    r = m.compute_metrics(fx.fx_pred(spark, sf_dir))
    return r.select("split", _r("mae", 4), _r("rmse", 4), _r("pearsonr"), _r("r2"))


def _models(spark, sf_dir):
    """Three model outputs per row (long form): pred * (1 + k/100), unc * (1 + k)."""
    u = fx.fx_unc(spark, sf_dir)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("model")
    long = u.select("row_id", "pred", "unc", k)
    return long.select("row_id", "model", (F.col("pred") * (F.lit(1) + F.col("model") / F.lit(100))).alias("pred"),
                       (F.col("unc") * (F.lit(1) + F.col("model"))).alias("unc"))


@register("a11_ensemble_mean",
          "SELECT row_id, 0.0 + round(avg(pred), 6) AS pred, 0.0 + round(avg(unc), 6) AS unc FROM ("
          "SELECT row_id, pred * (1 + model / 100) AS pred, unc * (1 + model) AS unc FROM "
          f"(SELECT row_id, pred, unc, unnest([0, 1, 2]) AS model FROM {UNC} u) x) y GROUP BY row_id")
def a11_ensemble_mean(spark, sf_dir):
    e = m.ensemble_mean(_models(spark, sf_dir), "row_id", "pred", "unc")
    # 6 decimals: these means are multiples of 1e-6/3, so no value sits on a rounding tie there
    return e.select("row_id", _r("pred", 6), _r("unc", 6))


@register("x6_parity_line",
          "SELECT CAST(i AS BIGINT) AS i, 0.0 + round(lo + i * 0.2, 6) AS x FROM ("
          "SELECT lo, unnest(range(0, CAST(ceil((hi - lo) / 0.2) AS BIGINT))) AS i FROM ("
          f"SELECT min(log10(label)) AS lo, max(log10(label)) AS hi FROM {PRED} p) a) b")
def x6_parity_line(spark, sf_dir):
    p = fx.fx_pred(spark, sf_dir).select(F.log10("label").alias("log_label"))
    return m.parity_line(p, "log_label", 0.2).select("i", _r("x"))


@register("w2_average_rank",
          "SELECT row_id, rank() OVER (ORDER BY unc) + (count(*) OVER (PARTITION BY unc) - 1) / 2.0 AS avg_rank "
          f"FROM {UNC} u")
def w2_average_rank(spark, sf_dir):
    u = fx.fx_unc(spark, sf_dir).select("row_id", "unc")
    return ranking.average_rank(u, "unc", "row_id").select("row_id", "avg_rank")


@register("w3_equal_bins", f"SELECT row_id, ntile(100) OVER (ORDER BY unc, row_id) AS bin FROM {UNC} u")
def w3_equal_bins(spark, sf_dir):
    u = fx.fx_unc(spark, sf_dir).select("row_id", "unc")
    return ranking.equal_bins(u, ["unc", "row_id"], 100).select("row_id", "bin")


@register("l6_z_scaling",
          f"SELECT split, count(*) AS n, 0.0 + round(avg((label - pred) * (label - pred) / (unc * s2)), 6) AS z2_mean "
          f"FROM {UNC} u, (SELECT avg((label - pred) * (label - pred) / unc) AS s2 FROM {UNC} v "
          f"WHERE split = 'Validation' AND {OK}) s WHERE {OK} GROUP BY split")
def l6_z_scaling(spark, sf_dir):
    """Fit s^2 on validation, rescale every variance; mean squared z-score per split (1.0 on validation)."""
    u = fx.fx_unc(spark, sf_dir)
    s2 = m.fit_z_scaling(u, fit_on="Validation")
    cal = m.apply_z_scaling(u, s2)
    e = F.col("label") - F.col("pred")
    return cal.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.avg(e * e / F.col("cal_unc")), 6).alias("z2_mean"))


@register("l7_nll",
          f"SELECT split, 0.0 + round(avg(0.5 * ln({2 * math.pi!r} * unc) + (label - pred) * (label - pred) / (2.0 * unc)), 6)"
          f" AS nll FROM {UNC} u WHERE {OK} GROUP BY split")
def l7_nll(spark, sf_dir):
    return m.nll(fx.fx_unc(spark, sf_dir)).select("split", _r("nll"))


def _cal_area_sql():
    t = "abs(label - pred) / sqrt(unc)"
    hits = ", ".join(f"sum(CASE WHEN {OK} AND {t} <= CAST('{z!r}' AS DOUBLE) THEN 1 ELSE 0 END) AS h{b}"
                     for b, z in enumerate(m.CAL_Z, start=1))
    area = " + ".join(f"0.01 * abs(h{b} / CAST(n AS DOUBLE) - CAST('{p!r}' AS DOUBLE))"
                      for b, p in enumerate(m.CAL_LEVELS, start=1))
    return (f"SELECT split, 0.0 + round(CASE WHEN n > 0 THEN {area} END, 6) AS cal_area, CAST(n_rejected AS BIGINT) AS n_rejected "
            f"FROM (SELECT split, sum(CASE WHEN {OK} THEN 1 ELSE 0 END) AS n, "
            f"sum(CASE WHEN {OK} THEN 0 ELSE 1 END) AS n_rejected, {hits} FROM {UNC} u GROUP BY split) a")


@register("l8_calibration_area", _cal_area_sql())
def l8_calibration_area(spark, sf_dir):
    return m.calibration_area(fx.fx_unc(spark, sf_dir)).select("split", _r("cal_area"), "n_rejected")


@register("l9_ence",
          "SELECT 0.0 + round(avg(abs(rmv - rmse) / rmv), 6) AS ence, count(*) AS n_bins FROM ("
          "SELECT bin, sqrt(avg(unc)) AS rmv, sqrt(avg((label - pred) * (label - pred))) AS rmse FROM ("
          "SELECT *, ntile(CAST(least(100, (SELECT count(*) FROM " + UNC + f" c WHERE split = 'Testing' AND {OK})) AS BIGINT)) "
          f"OVER (ORDER BY unc, row_id) AS bin FROM {UNC} u WHERE split = 'Testing' AND {OK}) b GROUP BY bin) g")
def l9_ence(spark, sf_dir):
    t = fx.fx_unc(spark, sf_dir).where(F.col("split") == "Testing")
    return m.ence(t, n_bins=100).select(_r("ence"), "n_bins")


@register("l10_spearman",
          "SELECT 0.0 + round(CASE WHEN stddev_pop(ru) = 0 OR stddev_pop(ra) = 0 THEN NULL ELSE "
          "covar_pop(ru, ra) / (stddev_pop(ru) * stddev_pop(ra)) END, 6) AS spearman FROM ("
          "SELECT rank() OVER (ORDER BY unc) + (count(*) OVER (PARTITION BY unc) - 1) / 2.0 AS ru, "
          "rank() OVER (ORDER BY ae) + (count(*) OVER (PARTITION BY ae) - 1) / 2.0 AS ra FROM ("
          f"SELECT unc, abs(label - pred) AS ae FROM {UNC} u WHERE split = 'Testing' AND {OK}) x) y")
def l10_spearman(spark, sf_dir):
    t = fx.fx_unc(spark, sf_dir).where(F.col("split") == "Testing")
    return m.uncertainty_error_spearman(t).select(_r("spearman"))


@register("x1_sqrt_of_aggregate",
          f"SELECT split, 0.0 + round(sqrt(avg((label - pred) * (label - pred))), 4) AS rmse FROM {PRED} p GROUP BY split")
def x1_sqrt_of_aggregate(spark, sf_dir):
    """Square root applied to an aggregate (RMSE = sqrt(MSE))."""
    e = F.col("label") - F.col("pred")
    return fx.fx_pred(spark, sf_dir).groupBy("split").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


@register("x2_absolute_value", f"SELECT row_id, abs(label - pred) AS abs_error FROM {PRED} p")
def x2_absolute_value(spark, sf_dir):
    """Absolute value per row."""
    return fx.fx_pred(spark, sf_dir).select("row_id", F.abs(F.col("label") - F.col("pred")).alias("abs_error"))
