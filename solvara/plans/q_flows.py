"""Flows that chain operators as the reference's scripts do, and exact property tables of the fitted models.

A fitted model's numbers have no SQL form, but what must hold of them has: rows scored per split, finite and
positive outputs, errors below the mean predictor's, equality after a save and load.  Each table here is computed
from the model's output; its oracle derives the expected rows from the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions.expressions import is_finite
from solvara.operators import descriptors as ds
from solvara.operators import boosting, graph, metrics, models, ranking, relational as rel, sampling, similarity, text, vectors
from solvara.plans import fixtures as fx
from solvara.plans import q_models as qm
from solvara.plans.registry import QUERIES, register
from solvara.session import drop_shuffles, write_once
from solvara.sources import tables as io

SPLITS = ("Training", "Validation", "Testing")
FEAT = f"({fx.FX_FEAT_SQL})"
PRED = f"({fx.FX_PRED_SQL})"


def _split_counts_sql(n: str, pct1: int, pct2_num: int, pct2_den: int, column: str = "split", tail: str = "") -> str:
    """Rows per split of the nested sampler for ``n`` rows, with whole-number arithmetic."""
    return (f"WITH n AS (SELECT {n} AS n), o AS (SELECT n, n * {pct1} // 100 AS outer_n FROM n), "
            f"t AS (SELECT n, outer_n, outer_n * {pct2_num} // {pct2_den} AS train_n FROM o) "
            f"SELECT 'Training' AS {column}, train_n AS n_rows{tail} FROM t "
            f"UNION ALL SELECT 'Validation', outer_n - train_n{tail} FROM t UNION ALL SELECT 'Testing', n - outer_n{tail} FROM t")


N_DOCS = "(SELECT count(*) FROM documents)"
QUOTA_SQL = _split_counts_sql(N_DOCS, 90, 9445, 10000, tail=", TRUE AS ok")


def _below_mean(label: str, pred: str, by: str):
    """Aggregate: on the training split the error is below that of the mean, which no constant model reaches."""
    e = F.col(label) - F.col(pred)
    return (F.sqrt(F.avg(e * e)) < F.stddev_pop(label)) | (F.first(by) != "Training")


def _scored_rows(scored: DataFrame, by: str = "split") -> DataFrame:
    """Rows per split; ok: every prediction is finite, and on the training split better than the mean."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"),
                                  (F.every(is_finite(F.col("pred"))) & _below_mean("label", "pred", by)).alias("ok"))


# ------------------------------------------------------------------ properties of L1-L5, L11, S6
@register("l1_properties", f"SELECT preset, split, count(*) AS n_rows, TRUE AS ok FROM {FEAT} f, "
                           "(VALUES ('viscosity'), ('logp'), ('enthalpy')) p(preset) GROUP BY preset, split")
def l1_properties(spark, sf_dir):
    """Every row scored by every setting; on the training split each explains a part of the variance."""
    t = QUERIES["l1_presets"](spark, sf_dir)
    ok = is_finite(F.col("rmse")) & ((F.col("r2") > 0) | (F.col("split") != "Training"))
    return t.select("preset", "split", F.col("n").alias("n_rows"), ok.alias("ok"))


@register("l2_properties", f"SELECT Set, count(*) AS n_rows, TRUE AS ok FROM (SELECT split AS Set FROM {FEAT} f) g GROUP BY Set")
def l2_properties(spark, sf_dir):
    """Every prediction is finite; on the training split the error is below that of the mean."""
    t = QUERIES["l2_score"](spark, sf_dir)
    ok = F.every(is_finite(F.col("price_pred"))) & _below_mean("price_exp", "price_pred", "Set")
    return t.groupBy("Set").agg(F.count("price_pred").alias("n_rows"), ok.alias("ok"))


_U = "('0x' || substr(md5('536|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0"


@register("l3_properties", f"SELECT CASE WHEN {_U} < 0.7 THEN 'Training' WHEN {_U} < 0.8 THEN 'Validation' ELSE 'Testing' END AS split, "
                           "count(*) AS n_rows, TRUE AS ok FROM documents GROUP BY 1")
def l3_properties(spark, sf_dir):
    t = sampling.hash_split(fx.fx_textfeat(spark, sf_dir), "row_id", [70, 10, 20], 536, labels=list(SPLITS))
    model = models.fit_text_regressor(rel.split_rows(t, "Training"), "smiles", "label")
    return _scored_rows(model.transform(t))


@register("l4_properties", "SELECT r AS run_id, t AS trees, n AS n_test, TRUE AS ok FROM (VALUES (0, 2000), (1, 2459)) v(r, t), "
                           f"(SELECT count(*) AS n FROM lineitem WHERE {qm.ITEM_SPLIT} = 'Testing') c")
def l4_properties(spark, sf_dir):
    """The best epoch lies at or before the stop, by its patience at most; the restored state has the least loss; one run is chosen."""
    t = QUERIES["l4_early_stopping"](spark, sf_dir)
    patience = F.element_at(F.array(*[F.lit(p) for p in qm.PATIENCE.values()]), F.col("run_id") + 1)
    waited = F.col("stop_epoch") - F.col("best_epoch")
    stopped = (waited == patience) | ((F.col("stop_epoch") == F.col("trees")) & (waited < patience))
    least = F.min("best_loss").over(Window.partitionBy())  # one row per run
    ok = (F.col("best_epoch") >= 1) & stopped & is_finite(F.col("test_mse")) & (F.col("chosen") == (F.col("best_loss") == least))
    return t.select("run_id", "trees", "n_test", ok.alias("ok"))


@register("l5_properties", f"SELECT split, count(*) AS n_rows, count(*) AS n_positive FROM {FEAT} f GROUP BY split")
def l5_properties(spark, sf_dir):
    """Every row has a positive, finite variance."""
    t = QUERIES["l5_mean_variance"](spark, sf_dir)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum(F.when(is_finite(F.col("unc")) & (F.col("unc") > 0), 1).otherwise(0)).alias("n_positive"))


@register("l11_properties", "SELECT count(*) AS n_rows, TRUE AS centred, TRUE AS ordered FROM documents")
def l11_properties(spark, sf_dir):
    """Both axes are centred and the first explains at least as much variance as the second."""
    bits = write_once(similarity.lingo_fingerprint(fx.fx_doc(spark, sf_dir), "smiles", 4, 512), "bits")
    xy = models.project_2d(bits)
    first, second = models.explained_variance(bits)
    return xy.agg(F.count(F.lit(1)).alias("n_rows"),
                  ((F.abs(F.avg("x")) < 1e-6) & (F.abs(F.avg("y")) < 1e-6)).alias("centred")).withColumn(
        "ordered", F.lit(bool(first >= second >= 0)))


@register("s6_properties", f"SELECT count(*) AS n_rows, count(*) AS n_equal FROM {FEAT} f")
def s6_properties(spark, sf_dir):
    t = QUERIES["s6_model_round_trip"](spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("pred_before") == F.col("pred_after"), 1).otherwise(0)).alias("n_equal"))


@register("flow_a_properties", _split_counts_sql(N_DOCS, 90, 9445, 10000, tail=", TRUE AS ok").replace("n_rows", "n"))
def flow_a_properties(spark, sf_dir):
    t = QUERIES["flow_a_split_featurize_fit"](spark, sf_dir)
    explains = (F.col("r2") > 0) | (F.col("split") != "Training")
    return t.select("split", "n", (is_finite(F.col("rmse")) & (F.col("mae") <= F.col("rmse") + 1e-9) & explains).alias("ok"))


@register("flow_b_properties", "SELECT metric, TRUE AS ok FROM (VALUES ('nll'), ('cal_area'), ('ence'), ('spearman')) v(metric)")
def flow_b_properties(spark, sf_dir):
    """The four report values are finite and in range."""
    t = QUERIES["flow_b_uncertainty_report"](spark, sf_dir)
    v = F.col("value")
    inside = F.when(F.col("metric") == "spearman", F.abs(v) <= 1 + 1e-9).when(F.col("metric") == "cal_area", v.between(0, 1)).otherwise(is_finite(v))
    return t.select("metric", inside.alias("ok"))


# ------------------------------------------------------------------ flows
def _write_predictions(spark, scored: DataFrame, prop: str) -> DataFrame:
    """P6 per split, J6, S2, and S1 back: the prediction table as a user of the files would see it."""
    parts = [rel.prediction_frame(rel.split_rows(scored, s), {"row_id": "SMILES"}, "label", "pred", prop) for s in SPLITS]
    path = io.write_table(rel.union_splits(parts), io.scratch_path(spark, prop))
    return io.read_table(spark, path, f"SMILES bigint, {prop}_exp double, {prop}_pred double, Set string")


def _prediction_rows(table: DataFrame, prop: str) -> DataFrame:
    """Rows per split; ok: all values are finite, and on the training split the error is below that of the mean."""
    finite = F.every(is_finite(F.col(f"{prop}_exp")) & is_finite(F.col(f"{prop}_pred")))
    return table.groupBy(F.col("Set").alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), (finite & _below_mean(f"{prop}_exp", f"{prop}_pred", "Set")).alias("ok"))


def _doc_table(spark, sf_dir) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("smiles"),
                    (F.lit(273.15) + (F.col("n_chars") % 100).cast("double")).alias("temp"),
                    F.log1p(F.col("n_chars").cast("double")).alias("label"))


@register("flow_c_fingerprint_model", QUOTA_SQL)
def flow_c_fingerprint_model(spark, sf_dir):
    """F1 bits -> sparse features -> F7 quota split -> L1 -> L2 -> P6, J6, S2: rows of the written table per split."""
    docs = _doc_table(spark, sf_dir)
    bits = write_once(similarity.lingo_fingerprint(docs, "smiles", 4, 256), "bits")
    split = sampling.three_way_split(bits, 256, "quota", 90, 94.45)
    feats = models.bit_vectors(bits, 256).join(docs.select("row_id", "label"), "row_id").join(split, "row_id")
    table = write_once(feats.select("row_id", "split", "label", boosting.feature_array(feats, "features").alias("features")), "features")
    model = boosting.fit_boosting(rel.split_rows(table, "Training"), "features", "label", **boosting.preset("viscosity"))
    scored = boosting.score_boosting(model, table, "features")
    return _prediction_rows(_write_predictions(spark, scored, "viscosity"), "viscosity")


@register("flow_d_substructure_words", f"SELECT split, count(*) AS n_rows, TRUE AS ok FROM {PRED} p "
                                       "WHERE row_id IN (SELECT l_orderkey FROM lineitem) GROUP BY split")
def flow_d_substructure_words(spark, sf_dir):
    """F3 identifier words -> word table -> A1 sums -> L1 -> P6, J6, S2: rows of the written table per split."""
    atoms = write_once(fx.fx_atoms(spark, sf_dir), "atoms")
    words = write_once(graph.identifier_sentences(atoms, fx.fx_bonds(spark, sf_dir, atoms), 1)
                       .select(F.col("mol_id").alias("row_id"), "word"), "words")
    drop_shuffles(spark)
    table = fx.word_table(words.select("word"), fx.table(spark, sf_dir, "embeddings"))
    # sums of 64 doubles a molecule are made anew for each pass: written or dealt they would be many times the input
    rows = vectors.word_sums(words, table, "row_id", "word", out="vec", beside=fx.fx_pred(spark, sf_dir).select("row_id", "label", "split"))
    drop_shuffles(spark)
    model = boosting.fit_boosting(rel.split_rows(rows, "Training"), "vec", "label", **boosting.preset("logp"))
    drop_shuffles(spark)
    scored = write_once(boosting.score_boosting(model, rows, "vec").drop("vec"), "scored")
    return _prediction_rows(_write_predictions(spark, scored, "logp"), "logp")


_ITEM_SPLIT = qm.ITEM_SPLIT


@register("flow_e_descriptor_model", f"SELECT {_ITEM_SPLIT} AS split, count(*) AS n_rows, TRUE AS ok FROM lineitem GROUP BY 1")
def flow_e_descriptor_model(spark, sf_dir):
    """A2/A3 on the training rows -> A4 -> L1 over the kept descriptors -> A8: rows scored per split."""
    d = fx.fx_desc(spark, sf_dir).withColumn("split", F.expr(_ITEM_SPLIT)).withColumn("label", F.log1p("charge"))
    kept, dropped = ds.drop_correlated(d, fx.FX_DESC_COLS, 0.7, fit_on="split = 'Training'")
    cols = [c for c in fx.FX_DESC_COLS if c not in dropped]
    scaled = write_once(ds.standardize(kept, cols, fit_on="split = 'Training'"), "scaled")
    model = boosting.fit_boosting(rel.split_rows(scaled, "Training"), cols, "label", **boosting.preset("viscosity"))
    return _scored_rows(boosting.score_boosting(model, scaled, cols))


_ROW_SPLIT = _ITEM_SPLIT.replace("l_orderkey", "vec_id")


@register("flow_e_profile_model", f"SELECT {_ROW_SPLIT} AS split, count(*) AS n_rows, TRUE AS ok FROM embeddings GROUP BY 1")
def flow_e_profile_model(spark, sf_dir):
    """A6 (block scaling and a standardized temperature) -> L1 -> A8: rows scored per split."""
    s = fx.fx_sigma(spark, sf_dir).withColumn("split", F.expr(_ROW_SPLIT.replace("vec_id", "row_id")))
    s = s.withColumn("label", sum((F.col(c) for c in fx.SIGMA_COLS), F.lit(0.0)))
    ready = write_once(ds.preprocess(s, [fx.SIGMA_COLS], ["temp"], fit_on="split = 'Training'"), "profile")
    cols = [*fx.SIGMA_COLS, "temp"]
    model = boosting.fit_boosting(rel.split_rows(ready, "Training"), cols, "label", **boosting.preset("viscosity"))
    return _scored_rows(boosting.score_boosting(model, ready, cols))


@register("flow_f_text_model", _split_counts_sql(N_DOCS, 80, 875, 1000, tail=", 512 AS n_ids, TRUE AS ok"))
def flow_f_text_model(spark, sf_dir):
    """F7 -> S2/S4 -> X3 -> X4 -> X5 -> L3 -> S6 -> L2 -> A10, X6, P6, S2: rows of the written table per split.

    n_ids is the length of every row's encoded input; ok: the loaded model's predictions are finite and A10 and the
    parity line have rows.
    """
    docs = _doc_table(spark, sf_dir)
    bits = write_once(similarity.lingo_fingerprint(docs, "smiles", 4, 512), "bits")
    split = sampling.three_way_split(bits, 512, "stratified", 80, 87.5)
    rows = write_once(docs.join(split, "row_id"), "split")
    paths = {s: io.write_table(rel.split_rows(rows, s).drop("split"), io.scratch_path(spark, s)) for s in SPLITS}
    t = io.read_splits(spark, paths, "row_id bigint, smiles string, temp double, label double", multi_line=True)
    t = write_once(text.tokenize_smiles(text.model_text(t, "smiles", ["temp"]), "model_text"), "tokens")
    encoded = text.encode(t, text.build_vocab(rel.split_rows(t, "Training"), "tokens", 1000), "tokens", 512)
    lengths = encoded.groupBy("split").agg(F.max(F.size("input_ids")).alias("n_ids"), F.min(F.size("input_ids")).alias("least"))
    model = models.fit_text_regressor(rel.split_rows(t, "Training"), "model_text", "label")
    loaded = io.load_model(io.save_model(model, io.scratch_path(spark, "text-model")))
    scored = write_once(loaded.transform(t).select("row_id", "split", "label", "pred"), "scored")
    report = metrics.compute_metrics(scored).count() == len(SPLITS) and metrics.parity_line(scored).limit(1).count() == 1
    table = _prediction_rows(_write_predictions(spark, scored, "viscosity"), "viscosity")
    return table.join(lengths, "split").select("split", "n_rows", "n_ids", (F.col("ok") & (F.col("least") == F.col("n_ids")) & F.lit(report)).alias("ok"))


@register("flow_g_sorted_unique_split", _split_counts_sql("(SELECT count(DISTINCT text) FROM documents)", 80, 875, 1000, tail=", TRUE AS ok"))
def flow_g_sorted_unique_split(spark, sf_dir):
    """D1 -> D2 -> F1 -> F7 stratified: rows per split; ok: every sort position of a split's rows is known and unique."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text").where(F.col("text").isNotNull())
    unique = write_once(rel.dedup_first(d, ["text"], "row_id"), "unique")
    ordered = ranking.global_rank(unique, ["text", "row_id"], "position", keep=["row_id"])
    split = sampling.three_way_split(similarity.lingo_fingerprint(unique, "text", 4, 512), 512, "stratified", 80, 87.5)
    return (split.join(ordered, "row_id", "left").groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"), (F.countDistinct("position") == F.count(F.lit(1))).alias("ok")))


@register("flow_h_uncertainty_selection",
          f"SELECT count(*) FILTER (WHERE split = 'Testing') AS n_test, TRUE AS ok FROM {FEAT} f")
def flow_h_uncertainty_selection(spark, sf_dir):
    """P8 -> P11 -> A7 -> L5 for two seeds -> D3 picks the run with the lower validation NLL -> rows of the test split.

    ok: no row was rejected or masked, the chosen run's loss is the smallest, and the two runs differ.
    """
    f = qm._feat(spark, sf_dir).withColumn("smiles", F.concat(F.lit("C"), F.col("row_id").cast("string")))
    good, rejected = rel.validate(f, "smiles", "label")
    masked = write_once(rel.finite_mask(good, "label"), "masked")
    usable = masked.where("label_mask")
    z = write_once(ds.fit_target_scaler(usable, "label").apply(usable, suffix="_z"), "scaled")
    losses, runs = [], {}
    for seed in (536, 537):
        mean_model, var_model = boosting.fit_mean_variance_boosting(rel.split_rows(z, "Training"), qm.FEATS, "label_z",
                                                                    **{**qm.CFG, "seed": seed})
        runs[seed] = write_once(boosting.predict_mean_variance_boosting(mean_model, var_model, z, qm.FEATS), "run")
        value = metrics.nll(rel.split_rows(runs[seed], "Validation"), "label_z", by=None).first()["nll"]
        losses.append((seed, 0, value))
    table = spark.createDataFrame(losses, "run_id int, epoch int, loss double")
    best = rel.best_run(table, "loss", tie=["run_id", "epoch"]).first()
    differ = runs[536].join(runs[537].select("row_id", F.col("pred").alias("other")), "row_id").where("pred <> other").limit(1).count()
    ok = (rejected.limit(1).count() == 0 and masked.where("NOT label_mask").limit(1).count() == 0
          and best["loss"] == min(x[2] for x in losses) and differ == 1)
    test = rel.split_rows(runs[best["run_id"]], "Testing")
    return test.agg(F.count(F.lit(1)).alias("n_test"), (F.every(F.col("unc") > 0) & F.lit(ok)).alias("ok"))
