"""Registered queries: descriptor correlation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import descriptors as ds
from solvara.plans import fixtures as fx
from solvara.plans.registry import register

DESC = f"({fx.FX_DESC_SQL})"
SIGMA = f"({fx.FX_SIGMA_SQL})"
PRED = f"({fx.FX_PRED_SQL})"
COLS = fx.FX_DESC_COLS


def _pair_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS col_i, '{b}' AS col_j, 0.0 + round(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 "
            f"THEN NULL ELSE abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))) END, 6) AS r FROM {DESC} d")


PAIRS_SQL = " UNION ALL ".join(_pair_sql(COLS[i], COLS[j]) for i in range(len(COLS)) for j in range(i + 1, len(COLS)))


@register("a2_abs_corr", PAIRS_SQL)
def a2_abs_corr(spark, sf_dir):
    return ds.abs_corr(fx.fx_desc(spark, sf_dir), COLS).select("col_i", "col_j", F.round("r", 6).alias("r"))


@register("a3_drop_correlated",
          f"SELECT DISTINCT col_j AS dropped FROM ({PAIRS_SQL}) p WHERE r IS NOT NULL AND r > 0.7")
def a3_drop_correlated(spark, sf_dir):
    """Names of the dropped columns (kept table is ``df.drop(*dropped)``)."""
    _, dropped = ds.drop_correlated(fx.fx_desc(spark, sf_dir), COLS, 0.7)
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


def _std_sql(cols, src, stats_expr):
    sel = ", ".join(f"0.0 + round(({c} - s.m_{c}) / s.d_{c}, 4) AS {c}" for c in cols)
    stats = ", ".join(stats_expr(c) for c in cols)
    return f"SELECT t.l_orderkey, t.l_linenumber, {sel} FROM {src} t, (SELECT {stats} FROM {src} u) s"


A4_SQL = _std_sql(COLS, DESC, lambda c: f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
                                        f"ELSE stddev_pop({c}) END AS d_{c}")


@register("a4_standardize", A4_SQL)
def a4_standardize(spark, sf_dir):
    d = ds.standardize(fx.fx_desc(spark, sf_dir), COLS)
    return d.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in COLS])


S = fx.SIGMA_COLS
_BLOCK_DIV = "CASE WHEN sqrt(" + " + ".join(f"var_pop({c})" for c in S) + ") = 0 THEN 1.0 ELSE sqrt(" + \
    " + ".join(f"var_pop({c})" for c in S) + ") END"
A5_SQL = ("SELECT t.row_id, " + ", ".join(f"0.0 + round(({c} - s.m_{c}) / s.div, 6) AS {c}" for c in S)
          + f" FROM {SIGMA} t, (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in S) + f", {_BLOCK_DIV} AS div FROM {SIGMA} u) s")


@register("a5_standardize_block", A5_SQL)
def a5_standardize_block(spark, sf_dir):
    d = ds.standardize_block(fx.fx_sigma(spark, sf_dir), S)
    return d.select("row_id", *[F.round(c, 6).alias(c) for c in S])


A6_SQL = ("SELECT t.row_id, " + ", ".join(f"0.0 + round(({c} - s.m_{c}) / s.div, 6) AS {c}" for c in S)
          + ", 0.0 + round((temp - s.m_temp) / s.d_temp, 6) AS temp"
          + f" FROM {SIGMA} t, (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in S)
          + f", {_BLOCK_DIV} AS div, avg(temp) AS m_temp, "
          + f"CASE WHEN stddev_pop(temp) = 0 THEN 1.0 ELSE stddev_pop(temp) END AS d_temp FROM {SIGMA} u) s")


@register("a6_preprocess", A6_SQL)
def a6_preprocess(spark, sf_dir):
    d = ds.preprocess(fx.fx_sigma(spark, sf_dir), blocks=[S], columns=["temp"])
    return d.select("row_id", *[F.round(c, 6).alias(c) for c in S + ["temp"]])


@register("a7_target_scaler",
          "SELECT row_id, split, 0.0 + round((label - s.m) / s.d, 6) AS y_scaled, 0.0 + round(label, 4) AS y_back FROM "
          f"{PRED} p, (SELECT avg(label) AS m, CASE WHEN stddev_pop(label) = 0 THEN 1.0 ELSE stddev_pop(label) END AS d "
          f"FROM {PRED} q WHERE split = 'Training') s")
def a7_target_scaler(spark, sf_dir):
    """Fit on training rows, apply to every split, then invert back to label units."""
    p = fx.fx_pred(spark, sf_dir)
    sc = ds.fit_target_scaler(p, "label")
    z = sc.apply(p, suffix="_z")
    back = sc.invert(z, "label_z", "y_back", "label")
    return back.select("row_id", "split", F.round("label_z", 6).alias("y_scaled"), F.round("y_back", 4).alias("y_back"))


L13_SQL = ("SELECT t.l_orderkey, t.l_linenumber, " + ", ".join(
    f"0.0 + round(CASE WHEN s.hi_{c} = s.lo_{c} THEN 0.0 ELSE ({c} - s.lo_{c}) / (s.hi_{c} - s.lo_{c}) END, 6) AS {c}" for c in COLS)
    + f" FROM {DESC} t, (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in COLS) + f" FROM {DESC} u) s")


@register("l13_minmax_scale", L13_SQL)
def l13_minmax_scale(spark, sf_dir):
    d = ds.minmax_scale(fx.fx_desc(spark, sf_dir), COLS)
    return d.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in COLS])


# ------------------------------------------------------------------ the same rules over frames with NULL and NaN
WIDE = 300


HOLED_SQL = ("(SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % 10 = 0 THEN NULL WHEN (l_orderkey + {i}) % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {c} END AS {c}"
    for i, c in enumerate(COLS)) + f" FROM {DESC} d)")
PRESENT_SQL = ("(SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in COLS)
               + f" FROM {HOLED_SQL} h)")


def fx_holed(spark, sf_dir):
    """FX-DESC with NULL and NaN in every column, of the same rows as ``HOLED_SQL``."""
    d, k = fx.fx_desc(spark, sf_dir), F.col("l_orderkey")
    return d.withColumns({c: F.when((k + i) % 10 == 0, F.lit(None).cast("double")).when((k + i) % 11 == 0, F.lit(float("nan"))).otherwise(F.col(c))
                          for i, c in enumerate(COLS)})


def _holed_pair_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS col_i, '{b}' AS col_j, 0.0 + round(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL "
            f"ELSE abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))) END, 6) AS r "
            f"FROM {PRESENT_SQL} d WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


HOLED_PAIRS_SQL = " UNION ALL ".join(_holed_pair_sql(COLS[i], COLS[j]) for i in range(len(COLS)) for j in range(i + 1, len(COLS)))


@register("a2_abs_corr_missing", HOLED_PAIRS_SQL)
def a2_abs_corr_missing(spark, sf_dir):
    """Pairwise-complete correlation: every pair over the rows that both columns have."""
    return ds.abs_corr(fx_holed(spark, sf_dir), COLS).select("col_i", "col_j", F.round("r", 6).alias("r"))


@register("a3_drop_correlated_missing", f"SELECT DISTINCT col_j AS dropped FROM ({HOLED_PAIRS_SQL}) p WHERE r IS NOT NULL AND r > 0.7")
def a3_drop_correlated_missing(spark, sf_dir):
    _, dropped = ds.drop_correlated(fx_holed(spark, sf_dir), COLS, 0.7)
    return spark.createDataFrame([(c,) for c in dropped], "dropped string")


def _holed(df):
    """NaN as -99, NULL as it is, so that the comparison tells them apart."""
    return df.select("l_orderkey", "l_linenumber", *[F.round(F.when(F.isnan(c), F.lit(-99.0)).otherwise(F.col(c)), 4).alias(c) for c in COLS])


def _holed_sql(stats, value) -> str:
    cols = ", ".join(f"0.0 + round(CASE WHEN t.{c} IS NULL THEN NULL WHEN isnan(t.{c}) THEN -99.0 ELSE {value(c)} END, 4) AS {c}" for c in COLS)
    return f"SELECT t.l_orderkey, t.l_linenumber, {cols} FROM {HOLED_SQL} t, (SELECT {', '.join(stats(c) for c in COLS)} FROM {PRESENT_SQL} u) s"


@register("a4_standardize_missing", _holed_sql(
    lambda c: f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS d_{c}",
    lambda c: f"(t.{c} - s.m_{c}) / s.d_{c}"))
def a4_standardize_missing(spark, sf_dir):
    """A4 over columns with NULL and NaN: both are left out of the statistics and stay in the rows."""
    return _holed(ds.standardize(fx_holed(spark, sf_dir), COLS))


@register("l13_minmax_scale_missing", _holed_sql(
    lambda c: f"min({c}) AS lo_{c}, max({c}) AS hi_{c}",
    lambda c: f"CASE WHEN s.hi_{c} = s.lo_{c} THEN 0.0 ELSE (t.{c} - s.lo_{c}) / (s.hi_{c} - s.lo_{c}) END"))
def l13_minmax_scale_missing(spark, sf_dir):
    return _holed(ds.minmax_scale(fx_holed(spark, sf_dir), COLS))


@register("a6_preprocess_missing", _holed_sql(
    lambda c: f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}",
    lambda c: (f"(t.{c} - s.m_{c}) / sqrt(" + " + ".join(f"s.v_{x}" for x in COLS[:3]) + ")") if c in COLS[:3]
    else f"(t.{c} - s.m_{c}) / CASE WHEN s.v_{c} = 0 THEN 1.0 ELSE sqrt(s.v_{c}) END"))
def a6_preprocess_missing(spark, sf_dir):
    """A5 over three columns and A4 over the others, with NULL and NaN."""
    return _holed(ds.preprocess(fx_holed(spark, sf_dir), blocks=[COLS[:3]], columns=COLS[3:]))


WIDE_SQL = (f"SELECT vec_id, k, CASE WHEN (vec_id + k) % 17 = 0 OR (vec_id + k) % 19 = 0 THEN NULL ELSE "
            f"CAST(embedding[k % 64 + 1] AS DOUBLE) + CAST(embedding[(k * 7 + 3) % 64 + 1] AS DOUBLE) * (k % 5) END AS x "
            f"FROM embeddings, range({WIDE}) r(k)")


@register("a2_abs_corr_wide",
          f"WITH long AS MATERIALIZED (SELECT * FROM ({WIDE_SQL}) w WHERE x IS NOT NULL) "
          "SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, 0.0 + round(abs(corr(a.x, b.x)), 5) AS r "
          "FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY a.k, b.k")
def a2_abs_corr_wide(spark, sf_dir):
    """|r| of all pairs of 300 descriptors with NULL and NaN, from one pass over the rows."""
    e, v = fx.table(spark, sf_dir, "embeddings"), F.col("vec_id")
    at = lambda i: F.element_at("embedding", i % 64 + 1).cast("double")
    cols = {f"d{k}": F.when((v + k) % 17 == 0, F.lit(None).cast("double")).when((v + k) % 19 == 0, F.lit(float("nan")))
            .otherwise(at(k) + at(k * 7 + 3) * float(k % 5)) for k in range(WIDE)}
    pairs = ds.abs_corr(e.select("vec_id", *[c.alias(n) for n, c in cols.items()]), list(cols))
    number = lambda c: F.substring(c, 2, 9).cast("int")
    return pairs.select(number(F.col("col_i")).alias("i"), number(F.col("col_j")).alias("j"), F.round("r", 5).alias("r"))
