"""Registered queries: model fitting, scoring, uncertainty, projection, persistence.

Fitted models have no SQL equivalent, so these have no oracle SQL; what must hold of them is registered next to them
(``*_properties``) and compared with DuckDB.  Boosting runs with the reference's own settings, from 1,864 to 2,459 trees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import boosting, metrics, models, relational as rel, sampling, similarity, vectors
from solvara.plans import fixtures as fx
from solvara.plans.registry import register
from solvara.session import write_once
from solvara.sources import tables as io

FEATS = ["qty", "disc", "tax"]
CFG = boosting.preset("viscosity")


def _feat(spark, sf_dir):
    """FX-FEAT without the fixture's own ``pred`` column (the models write theirs)."""
    return fx.fx_feat(spark, sf_dir).drop("pred")


@register("l1_gbt_metrics")
def l1_gbt_metrics(spark, sf_dir):
    """Fit the viscosity setting on the training split, score every split once, metrics per split."""
    f = _feat(spark, sf_dir)
    model = boosting.fit_boosting(rel.split_rows(f, "Training"), FEATS, "label", **CFG)
    return metrics.regression_metrics(boosting.score_boosting(model, f, FEATS), "label", "pred", "split")


@register("l1_presets")
def l1_presets(spark, sf_dir):
    """The three settings fitted side by side on one sample; every row scored by all in one pass; metrics per setting and split."""
    f = _feat(spark, sf_dir)
    sample = write_once(boosting.fit_sample(rel.split_rows(f, "Training"), FEATS, "label"), "sample")
    names = list(models.GBT_PRESETS)
    fitted = dict(zip(names, boosting.fit_many(sample, [(None, boosting.preset(n)) for n in names])))
    scored = write_once(boosting.score_many(fitted, f, FEATS), "scored")
    return rel.union_splits([metrics.regression_metrics(scored, "label", n, "split").withColumn("preset", F.lit(n)) for n in names])


@register("l2_score")
def l2_score(spark, sf_dir):
    """Prediction table in the reference's layout (P6) for every split, by the logP setting."""
    f = _feat(spark, sf_dir)
    model = boosting.fit_boosting(rel.split_rows(f, "Training"), FEATS, "label", **boosting.preset("logp"))
    return rel.prediction_frame(boosting.score_boosting(model, f, FEATS), {"row_id": "SMILES"}, "label", "pred", "price")


@register("l3_text_regression")
def l3_text_regression(spark, sf_dir):
    """Regression from molecule text (tokens -> TF-IDF -> linear), hash split 70/10/20, metrics per split."""
    t = sampling.hash_split(fx.fx_textfeat(spark, sf_dir), "row_id", [70, 10, 20], 536,
                            labels=["Training", "Validation", "Testing"])
    model = models.fit_text_regressor(rel.split_rows(t, "Training"), "smiles", "label")
    return metrics.compute_metrics(model.transform(t), "label", "pred", "split")


# Epochs without improvement that the graph models wait for (viscosity, logP).
PATIENCE = {"viscosity": 250, "logp": 50}


CHARGE_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
ITEM_SPLIT = "CASE WHEN l_orderkey % 20 < 14 THEN 'Training' WHEN l_orderkey % 20 < 16 THEN 'Validation' ELSE 'Testing' END"


def fx_charge(spark, sf_dir):
    """FX-DESC with what a line is charged, at one price, as a label that its features explain only in part."""
    d = fx.fx_desc(spark, sf_dir)
    noise = F.col("l_extendedprice") / F.lit(2000.0)
    return d.select(*CHARGE_FEATS, (F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) + noise).alias("label"),
                    F.expr(ITEM_SPLIT).alias("split"))


@register("l4_early_stopping")
def l4_early_stopping(spark, sf_dir):
    """Two runs with patience on the validation split, their best states restored; D3 picks the run; error on the test split.

    One row per run: trees fitted, the best and the stopping epoch, the least validation loss, whether D3 chose it, and the
    test split's mean squared error of the restored model and of the uncut one.
    """
    f = fx_charge(spark, sf_dir)
    train, validation, test = (rel.split_rows(f, s) for s in ("Training", "Validation", "Testing"))
    settings = {i: boosting.preset(n) for i, n in enumerate(PATIENCE)}
    sample = boosting.fit_sample(train, CHARGE_FEATS, "label")
    full = dict(zip(settings, boosting.fit_many(sample, [(None, s) for s in settings.values()])))
    losses = write_once(boosting.staged_losses(full, validation, CHARGE_FEATS, "label"), "losses")
    stops = rel.union_splits([boosting.best_epochs(losses.where(F.col("run_id") == i), p) for i, p in enumerate(PATIENCE.values())])
    stops = write_once(stops, "stops")
    restored = {r["run_id"]: full[r["run_id"]].cut(r["best_epoch"]) for r in stops.collect()}
    names = {f"{how}_{i}": m for how, group in (("cut", restored), ("full", full)) for i, m in group.items()}
    scored = boosting.score_many(names, test, CHARGE_FEATS)
    error = scored.agg(*[F.avg(F.pow(F.col("label") - F.col(n), 2)).alias(n) for n in names], F.count(F.lit(1)).alias("n_test")).first()
    best = rel.best_run(losses, "loss", tie=["run_id", "epoch"]).select("run_id", F.lit(True).alias("chosen"))
    tests = spark.createDataFrame([(i, m.n_trees, error["n_test"], error[f"cut_{i}"], error[f"full_{i}"]) for i, m in full.items()],
                                  "run_id int, trees int, n_test long, test_mse double, uncut_test_mse double")
    return (stops.join(tests, "run_id").join(best, "run_id", "left")
            .select("run_id", "trees", "best_epoch", "stop_epoch", "best_loss", F.coalesce("chosen", F.lit(False)).alias("chosen"),
                    "n_test", "test_mse", "uncut_test_mse"))


@register("l5_mean_variance")
def l5_mean_variance(spark, sf_dir):
    """Prediction plus uncertainty per row; then z-scaling (L6) and NLL (L7) per split."""
    f = _feat(spark, sf_dir)
    mean_m, var_m = boosting.fit_mean_variance_boosting(rel.split_rows(f, "Training"), FEATS, "label", **CFG)
    pv = write_once(boosting.predict_mean_variance_boosting(mean_m, var_m, f, FEATS), "scored")
    s2 = metrics.fit_z_scaling(pv, fit_on="Validation")
    cal = metrics.apply_z_scaling(pv, s2, "unc", "cal_unc")
    return cal.select("row_id", "split", "label", "pred", "unc", "cal_unc")


@register("l11_project_2d")
def l11_project_2d(spark, sf_dir):
    """2-D coordinates of the document fingerprints, labelled with the three-way split."""
    bits = write_once(similarity.lingo_fingerprint(fx.fx_doc(spark, sf_dir), "smiles", 4, 512))
    xy = models.project_2d(bits)
    split = sampling.three_way_split(bits, 512, "quota", 90, 94.45)
    return xy.join(split, "row_id", "inner")


@register("s6_model_round_trip")
def s6_model_round_trip(spark, sf_dir):
    """Save a fitted model, load it back, score with both: predictions must be equal."""
    f = _feat(spark, sf_dir)
    model = boosting.fit_boosting(rel.split_rows(f, "Training"), FEATS, "label", **boosting.preset("enthalpy"))
    loaded = boosting.load_forest(spark, boosting.save_forest(spark, model, io.scratch_path(spark, "forest")))
    both = boosting.score_many({"pred_before": model, "pred_after": loaded}, f, FEATS)
    return both.select("row_id", "pred_before", "pred_after")


@register("flow_a_split_featurize_fit")
def flow_a_split_featurize_fit(spark, sf_dir):
    """The tabular-regression flow end to end on the documents table.

    fingerprint (F1) -> quota split 85/5/10 (F7) -> sentence vectors of the words (A1) + a temperature
    column (P10) -> boosting fitted on the training split (L1) -> scored once over all splits (L2) ->
    metrics per split (A8).  The target is the document length in characters.
    """
    d = fx.table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("smiles"),
                    F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"),
                    (F.lit(273.15) + (F.col("n_chars") % 100).cast("double")).alias("temp"),
                    F.log1p(F.col("n_chars").cast("double")).alias("label"))
    bits = similarity.lingo_fingerprint(docs, "smiles", 4, 512)
    split = sampling.three_way_split(bits, 512, "quota", 90, 94.45)
    sv = vectors.sentence_vectors(docs, "tokens", fx.fx_wordvec(spark, sf_dir), "row_id", "UNK", "vec")
    feats = rel.assemble(sv.join(docs.select("row_id", "temp", "label"), "row_id"), "vec", ["temp"], "x")
    table = write_once(feats.join(split, "row_id").select("row_id", "split", "label", "x"))
    model = boosting.fit_boosting(rel.split_rows(table, "Training"), "x", "label", **CFG)
    scored = boosting.score_boosting(model, table, "x")
    return metrics.regression_metrics(scored, "label", "pred", "split")


@register("flow_b_uncertainty_report")
def flow_b_uncertainty_report(spark, sf_dir):
    """The regression-with-uncertainty flow end to end on the prediction features.

    three split files read back as one table (S4) -> rows with a finite target only (P7) -> every split
    present (P9) -> target scaled on the training split (A7) -> two mean-variance models with different
    seeds (L5), averaged (A11) -> predictions back in label units -> z-scaling fitted on validation (L6)
    -> NLL, calibration area, ENCE and Spearman on the test split (L7-L10), one row per metric.
    """
    f = _feat(spark, sf_dir)
    paths = {name: io.write_table(rel.split_rows(f, name).drop("split"), io.scratch_path(spark, name), "csv")
             for name in ("Training", "Validation", "Testing")}
    t = io.read_splits(spark, paths, "row_id bigint, label double, qty double, disc double, tax double")
    t = write_once(rel.drop_missing(t, ["label"]))
    rel.require_nonempty(t)
    from solvara.operators import descriptors as ds
    scaler = ds.fit_target_scaler(t, "label")
    z = scaler.apply(t, suffix="_z")
    train = rel.split_rows(z, "Training")
    runs = []
    for seed in (536, 537):
        mm, vm = boosting.fit_mean_variance_boosting(train, FEATS, "label_z", **{**CFG, "seed": seed})
        runs.append(boosting.predict_mean_variance_boosting(mm, vm, z, FEATS).select("row_id", "pred", "unc"))
    ens = metrics.ensemble_mean(runs[0].unionByName(runs[1]), "row_id", "pred", "unc")
    # back to label units: pred * s + m, variance * s^2
    s = scaler.scale["label"]
    back = scaler.invert(ens, "pred", "pred", "label").withColumn("unc", F.col("unc") * F.lit(s * s))
    scored = write_once(t.join(back, "row_id", "inner"))
    s2 = metrics.fit_z_scaling(scored, fit_on="Validation")
    cal = metrics.apply_z_scaling(scored, s2, "unc", "cal_unc").drop("unc").withColumnRenamed("cal_unc", "unc")
    test = rel.split_rows(cal, "Testing")
    parts = [metrics.nll(test, by=None).select(F.lit("nll").alias("metric"), F.col("nll").alias("value")),
             metrics.calibration_area(test, by=None).select(F.lit("cal_area").alias("metric"),
                                                             F.col("cal_area").alias("value")),
             metrics.ence(test).select(F.lit("ence").alias("metric"), F.col("ence").alias("value")),
             metrics.uncertainty_error_spearman(test).select(F.lit("spearman").alias("metric"),
                                                             F.col("spearman").alias("value"))]
    return rel.union_splits(parts)
