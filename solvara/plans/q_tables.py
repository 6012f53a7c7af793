"""Registered queries: sources/sinks, projections, keyed joins, dedup and sort (S*, P*, J*, D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import ranking, relational as rel
from solvara.plans import fixtures as fx
from solvara.plans.registry import register
from solvara.sources import tables as io

PRED = f"({fx.FX_PRED_SQL})"
PRED_SCHEMA = "row_id bigint, label double, pred double, split string"


# ------------------------------------------------------------------ S1-S4, S8
@register("s1_s2_csv_round_trip", f"SELECT * FROM {PRED} p")
def s1_s2_csv_round_trip(spark, sf_dir):
    """Write the prediction table as CSV (S2) and read it back with a declared schema."""
    path = io.scratch_path(spark, "pred-csv")
    io.write_table(fx.fx_pred(spark, sf_dir), path, "csv")
    return io.read_table(spark, path, PRED_SCHEMA)


@register("s1_text_round_trip", "SELECT doc_id, text, lang FROM documents")
def s1_text_round_trip(spark, sf_dir):
    """Whole multi-line, multi-language texts survive the CSV writer and the multi-line reader."""
    path = io.scratch_path(spark, "docs-csv")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    io.write_table(docs, path, "csv")
    return io.read_table(spark, path, "doc_id bigint, text string, lang string", multi_line=True)


@register("s3_feature_round_trip",
          "SELECT vec_id AS row_id, CAST(len(embedding) AS INTEGER) AS n_dims, "
          "0.0 + round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS vec_sum FROM embeddings")
def s3_feature_round_trip(spark, sf_dir):
    """Persist an array feature table as parquet (S3) and reload it."""
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    path = io.scratch_path(spark, "features")
    io.save_features(e, path)
    back = io.load_features(spark, path)
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("row_id", F.size("vec").alias("n_dims"), F.round(total, 4).alias("vec_sum"))


@register("s4_read_splits", f"SELECT split, count(*) AS n_rows, 0.0 + round(sum(label), 2) AS label_sum FROM {PRED} p GROUP BY split")
def s4_read_splits(spark, sf_dir):
    """Write one CSV per split, load them as a dict of splits (S4), count per split."""
    p = fx.fx_pred(spark, sf_dir)
    paths = {}
    for name in ("Training", "Validation", "Testing"):
        paths[name] = io.write_table(rel.split_rows(p, name).drop("split"), io.scratch_path(spark, name), "csv")
    back = io.read_splits(spark, paths, "row_id bigint, label double, pred double")
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.sum("label"), 2).alias("label_sum"))


@register("s8_profile",
          f"SELECT 'read' AS stage, count(*) AS n_rows, 4 AS n_cols FROM {PRED} p "
          f"UNION ALL SELECT 'training', count(*), 4 FROM {PRED} p WHERE split = 'Training' "
          f"UNION ALL SELECT 'features', count(*), 7 FROM ({fx.FX_FEAT_SQL}) f")
def s8_profile(spark, sf_dir):
    """Row and column counts at three steps, one report table."""
    p = fx.fx_pred(spark, sf_dir)
    return rel.union_splits([io.profile(p, "read"), io.profile(rel.split_rows(p, "Training"), "training"),
                             io.profile(fx.fx_feat(spark, sf_dir), "features")]).select(
        "stage", "n_rows", F.col("n_cols").cast("int").alias("n_cols"))


# ------------------------------------------------------------------ P1-P12
@register("p1_select", f"SELECT row_id, label FROM {PRED} p")
def p1_select(spark, sf_dir):
    return fx.fx_pred(spark, sf_dir).select("row_id", "label")


@register("p2_select_except",
          "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
          f"FROM ({fx.FX_DESC_SQL}) d")
def p2_select_except(spark, sf_dir):
    return rel.select_except(fx.fx_desc(spark, sf_dir), ["disc_price", "charge", "const5", "Name"])


@register("p3_split_rows", f"SELECT * FROM {PRED} p WHERE split = 'Validation'")
def p3_split_rows(spark, sf_dir):
    return rel.split_rows(fx.fx_pred(spark, sf_dir), "Validation")


@register("p4_replace_columns",
          f"SELECT p.row_id, p.label, p.split, p.pred * 2 AS pred FROM {PRED} p")
def p4_replace_columns(spark, sf_dir):
    p = fx.fx_pred(spark, sf_dir)
    upd = p.select("row_id", (F.col("pred") * 2).alias("pred"))
    return rel.replace_columns(p, upd)


@register("p5_constant_column", f"SELECT row_id, 'Training' AS Set FROM {PRED} p WHERE split = 'Training'")
def p5_constant_column(spark, sf_dir):
    p = rel.split_rows(fx.fx_pred(spark, sf_dir), "Training")
    return p.select("row_id", F.lit("Training").alias("Set"))


@register("p6_prediction_frame",
          f"SELECT row_id AS SMILES, label AS viscosity_exp, pred AS viscosity_pred, split AS Set FROM {PRED} p")
def p6_prediction_frame(spark, sf_dir):
    return rel.prediction_frame(fx.fx_pred(spark, sf_dir), {"row_id": "SMILES"}, "label", "pred", "viscosity")


@register("p7_drop_missing", f"SELECT * FROM ({fx.FX_MISSING_SQL}) m WHERE x IS NOT NULL AND NOT isnan(x)")
def p7_drop_missing(spark, sf_dir):
    return rel.drop_missing(fx.fx_missing(spark, sf_dir), ["x"])


_ALPHA_DUCK = r"[A-Za-z0-9()\[\]=#\-+\\/:~@?>*$%.]+"
# Strings to validate: whole texts whose commas and line breaks stand for brackets (so nesting goes wrong in some),
# urls, their query parts (often empty) and label values (missing for unlabelled documents).
P8_INPUT_SQL = """
SELECT doc_id * 8 AS row_id, replace(replace(replace(replace(text, ',', '('), chr(10), ')'), ' ', ''), '|', '[') AS smiles FROM documents
UNION ALL SELECT page_id * 8 + 1, url FROM pages
UNION ALL SELECT page_id * 8 + 2, regexp_extract(url, '[?]([^#]*)', 1) FROM pages
UNION ALL SELECT d.doc_id * 8 + 3, CAST(min(l.quality) AS VARCHAR) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id
UNION ALL SELECT conv_id * 8000 + turn * 8 + 4, text FROM conversations"""


def _depth_sql(opening: str, closing: str) -> str:
    marks = f"regexp_replace(smiles, '[^\\{opening}\\{closing}]', '', 'g')"
    steps = (f"list_prepend(0, list_transform(string_split({marks}, ''), "
             f"lambda c: CASE c WHEN '{opening}' THEN 1 WHEN '{closing}' THEN -1 ELSE 0 END))")
    return f"list_reduce({steps}, lambda d, x: CASE WHEN d < 0 THEN d ELSE d + x END)"


P8_SQL = f"""
SELECT row_id, CASE WHEN smiles IS NULL THEN 'missing_smiles'
                    WHEN length(smiles) = 0 THEN 'empty_smiles'
                    WHEN NOT regexp_full_match(smiles, '{_ALPHA_DUCK}') THEN 'bad_character'
                    WHEN {_depth_sql('(', ')')} <> 0 THEN 'unbalanced_parentheses'
                    WHEN {_depth_sql('[', ']')} <> 0 THEN 'unbalanced_brackets'
               END AS reason
FROM ({P8_INPUT_SQL}) t"""


def p8_input(spark, sf_dir):
    """(row_id, smiles) of ``P8_INPUT_SQL``: every rule of the validator meets whole strings."""
    t = lambda name: fx.table(spark, sf_dir, name)
    docs, pages = t("documents"), t("pages")
    labels = t("labels").groupBy("doc_id").agg(F.min("quality").cast("string").alias("smiles"))
    parts = [docs.select(F.col("doc_id") * 8, F.translate("text", ",\n| ", "()[")),
             pages.select(F.col("page_id") * 8 + 1, "url"),
             pages.select(F.col("page_id") * 8 + 2, F.regexp_extract("url", "[?]([^#]*)", 1)),
             docs.select("doc_id").distinct().join(labels, "doc_id", "left").select(F.col("doc_id") * 8 + 3, "smiles"),
             t("conversations").select(F.col("conv_id") * 8000 + F.col("turn") * 8 + 4, "text")]
    return rel.union_splits([p.toDF("row_id", "smiles") for p in parts])


@register("p8_validate", P8_SQL)
def p8_validate(spark, sf_dir):
    """Every row with its first failing rule (NULL reason = good row)."""
    good, rejects = rel.validate(p8_input(spark, sf_dir), "smiles")
    return good.select("row_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("row_id", "reason"))


@register("p9_split_presence",
          f"SELECT s.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows FROM (VALUES ('Training'), ('Validation'), "
          f"('Testing')) s(split) LEFT JOIN (SELECT split, count(*) AS n FROM {PRED} p GROUP BY split) c "
          "ON s.split = c.split")
def p9_split_presence(spark, sf_dir):
    return rel.require_nonempty(fx.fx_pred(spark, sf_dir))


@register("p10_assemble",
          "SELECT row_id, CAST(len(embedding) + 1 AS INTEGER) AS n_feat, "
          "0.0 + round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 273.15 + CAST(label AS DOUBLE), 4) "
          "AS feat_sum FROM (SELECT vec_id AS row_id, embedding, label FROM embeddings) e")
def p10_assemble(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", (F.lit(273.15) + F.col("label").cast("double")).alias("temp"))
    a = rel.assemble(e, "embedding", ["temp"], "features")
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return a.select("row_id", F.size("features").alias("n_feat"), F.round(total, 4).alias("feat_sum"))


@register("p11_finite_mask",
          "SELECT row_id, x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AS x_mask, "
          "CASE WHEN x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) THEN x ELSE 0.0 END AS x_filled "
          f"FROM ({fx.FX_MISSING_SQL}) m")
def p11_finite_mask(spark, sf_dir):
    return rel.finite_mask(fx.fx_missing(spark, sf_dir), "x").drop("x")


@register("p12_label_column", f"SELECT row_id, label, label AS labels FROM {PRED} p")
def p12_label_column(spark, sf_dir):
    return fx.fx_pred(spark, sf_dir).select("row_id", "label").withColumn("labels", F.col("label"))


# ------------------------------------------------------------------ J1-J4, J6
@register("j1_zip_tables", f"SELECT p.row_id, p.label, f.qty FROM {PRED} p JOIN ({fx.FX_FEAT_SQL}) f ON p.row_id = f.row_id")
def j1_zip_tables(spark, sf_dir):
    f = fx.fx_feat(spark, sf_dir)
    a = f.select("row_id", "label")
    b = f.select("row_id", "qty")
    return rel.zip_tables(a, b)


@register("j2_take", f"SELECT * FROM {PRED} p WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j2_take(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("row_id"))
    return rel.take(fx.fx_pred(spark, sf_dir), ids)


@register("j3_remaining", f"SELECT * FROM {PRED} p WHERE row_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def j3_remaining(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("row_id"))
    return rel.remaining(fx.fx_pred(spark, sf_dir), ids)


@register("j4_set_where",
          f"SELECT row_id, label, pred, CASE WHEN row_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) "
          f"THEN 'Validation' ELSE split END AS split FROM {PRED} p")
def j4_set_where(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("row_id"))
    return rel.set_where(fx.fx_pred(spark, sf_dir), ids, "split", "Validation")


@register("j6_union_splits",
          f"SELECT row_id, label, pred, 'Training' AS Set FROM {PRED} p WHERE split = 'Training' UNION ALL "
          f"SELECT row_id, label, pred, 'Validation' FROM {PRED} p WHERE split = 'Validation' UNION ALL "
          f"SELECT row_id, label, pred, 'Testing' FROM {PRED} p WHERE split = 'Testing'")
def j6_union_splits(spark, sf_dir):
    p = fx.fx_pred(spark, sf_dir)
    parts = [rel.split_rows(p, s).select("row_id", "label", "pred", F.lit(s).alias("Set"))
             for s in ("Training", "Validation", "Testing")]
    return rel.union_splits(parts)


# ------------------------------------------------------------------ D1-D3
@register("d1_dedup_first",
          "SELECT doc_id AS row_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) "
          "AS rn FROM documents) d WHERE rn = 1")
def d1_dedup_first(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "source")
    return rel.dedup_first(d, ["text"], "row_id").select("row_id", "lang", "source")


@register("d2_sort_string_key",
          "SELECT row_id, row_number() OVER (ORDER BY text, row_id) - 1 AS sort_rank FROM ("
          "SELECT doc_id AS row_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) "
          "AS rn FROM documents) d WHERE rn = 1) u")
def d2_sort_string_key(spark, sf_dir):
    """Deduplicate texts, then sort ascending by the string (byte order = code-point order)."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    u = rel.dedup_first(d, ["text"], "row_id")
    return ranking.global_rank(u, ["text", "row_id"], "sort_rank", keep=["row_id"])


@register("d3_best_epoch_per_run",
          "SELECT run_id, epoch, val_loss_c FROM (SELECT *, row_number() OVER (PARTITION BY run_id "
          f"ORDER BY val_loss_c, epoch) AS rn FROM ({fx.FX_RUNS_SQL}) r) t WHERE rn = 1")
def d3_best_epoch_per_run(spark, sf_dir):
    return rel.best_run(fx.fx_runs(spark, sf_dir), "val_loss_c", by="run_id", tie="epoch")


@register("d3_best_run",
          f"SELECT run_id, epoch, val_loss_c FROM ({fx.FX_RUNS_SQL}) r ORDER BY val_loss_c, run_id, epoch LIMIT 1")
def d3_best_run(spark, sf_dir):
    return rel.best_run(fx.fx_runs(spark, sf_dir), "val_loss_c", tie=["run_id", "epoch"]).select("run_id", "epoch", "val_loss_c")
