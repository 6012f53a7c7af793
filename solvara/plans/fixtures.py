"""Input tables derived from the driver's parquet tables (FIXTURES.md), as Spark DataFrames.

Each builder reads whole tables; the matching DuckDB text (``*_SQL``) is used inside the oracle
queries, so both engines start from the same rows.  Texts are used whole (no prefix cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.operators.ranking import global_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- FX-DOC
FX_DOC_SQL = "SELECT doc_id AS row_id, text AS smiles FROM documents"


def fx_doc(spark, sf_dir) -> DataFrame:
    """(row_id BIGINT, smiles STRING): stand-in molecule strings, whole document texts."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("smiles"))


# ---------------------------------------------------------------- FX-PRED
FX_PRED_SQL = (
    "SELECT o_orderkey AS row_id, o_totalprice AS label, "
    "o_totalprice * (80 + o_orderkey % 41) / 100 AS pred, "
    "CASE WHEN o_orderkey % 20 < 14 THEN 'Training' WHEN o_orderkey % 20 < 16 THEN 'Validation' "
    "ELSE 'Testing' END AS split FROM orders")


def fx_pred(spark, sf_dir) -> DataFrame:
    """(row_id, label, pred, split): a prediction table with a 70/10/20 split label."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_id"),
        F.col("o_totalprice").alias("label"),
        (F.col("o_totalprice") * (F.lit(80) + k % 41) / F.lit(100)).cast("double").alias("pred"),
        F.when(k % 20 < 14, F.lit("Training")).when(k % 20 < 16, F.lit("Validation"))
        .otherwise(F.lit("Testing")).alias("split"))


# ---------------------------------------------------------------- FX-UNC
FX_UNC_SQL = f"SELECT p.*, CAST(1 + row_id % 97 AS DOUBLE) * 1000000 AS unc FROM ({FX_PRED_SQL}) p"


def fx_unc(spark, sf_dir) -> DataFrame:
    """fx_pred + unc (variance > 0, 97 distinct values, so ranks tie)."""
    p = fx_pred(spark, sf_dir)
    return p.withColumn("unc", (F.lit(1) + F.col("row_id") % 97).cast("double") * F.lit(1000000.0))


# ---------------------------------------------------------------- FX-RUNS
FX_RUNS_SQL = (
    "SELECT row_id % 7 AS run_id, row_id % 13 AS epoch, "
    "CAST(round(avg(abs(label - pred)) * 100) AS BIGINT) AS val_loss_c "
    f"FROM ({FX_PRED_SQL}) p GROUP BY 1, 2")


def fx_runs(spark, sf_dir) -> DataFrame:
    """(run_id, epoch, val_loss_c): a monitored metric per run and epoch, in integer hundredths."""
    p = fx_pred(spark, sf_dir)
    return (p.groupBy((F.col("row_id") % 7).alias("run_id"), (F.col("row_id") % 13).alias("epoch"))
            .agg(F.round(F.avg(F.abs(F.col("label") - F.col("pred"))) * 100).cast("bigint").alias("val_loss_c")))


# ---------------------------------------------------------------- FX-DESC
FX_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "disc_price", "charge", "const5"]
FX_DESC_SQL = (
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_extendedprice * (1 - l_discount) AS disc_price, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CAST(5 AS DOUBLE) AS const5 FROM lineitem")


def fx_desc(spark, sf_dir) -> DataFrame:
    """Seven descriptor columns (two strongly correlated derived ones and a constant one)."""
    li = table(spark, sf_dir, "lineitem")
    ep, dc, tx = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (ep * (F.lit(1) - dc)).alias("disc_price"),
        (ep * (F.lit(1) - dc) * (F.lit(1) + tx)).alias("charge"),
        F.lit(5.0).alias("const5"))


# ---------------------------------------------------------------- FX-MISSING
FX_MISSING_SQL = (
    "SELECT event_id AS row_id, CASE WHEN event_id % 10 = 0 THEN NULL "
    "WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) "
    "WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS x FROM events")


def fx_missing(spark, sf_dir) -> DataFrame:
    """(row_id, x) with NULL, NaN and Infinity rows."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    x = (F.when(k % 10 == 0, F.lit(None).cast("double"))
         .when(k % 11 == 0, F.lit(float("nan")))
         .when(k % 13 == 0, F.lit(float("inf")))
         .otherwise(F.col("value")))
    return e.select(k.alias("row_id"), x.alias("x"))


# ---------------------------------------------------------------- FX-GRAPH
FX_ATOMS_SQL = (
    "SELECT l_orderkey AS mol_id, l_linenumber AS atom_id, "
    "min(concat(l_returnflag, l_linestatus)) AS invariant FROM lineitem GROUP BY l_orderkey, l_linenumber")
FX_BONDS_SQL = (
    f"SELECT a.mol_id, a.atom_id AS src, b.atom_id AS dst, (a.atom_id + b.atom_id) % 3 AS bond_type "
    f"FROM ({FX_ATOMS_SQL}) a JOIN ({FX_ATOMS_SQL}) b ON a.mol_id = b.mol_id "
    f"AND (b.atom_id = a.atom_id + 1 OR b.atom_id = a.atom_id - 1)")


def fx_atoms(spark, sf_dir) -> DataFrame:
    """(mol_id, atom_id, invariant): one molecule per order, one atom per distinct line number."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").alias("atom_id"))
            .agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("invariant")))


def fx_bonds(spark, sf_dir, atoms: DataFrame | None = None) -> DataFrame:
    """(mol_id, src, dst, bond_type): both directions between consecutive atom ids.

    Written as two equi-joins (dst = src + 1, and its mirror) rather than an OR condition, so the
    plan stays a hash join on (mol_id, atom) and never becomes a nested loop.
    """
    atoms = atoms if atoms is not None else fx_atoms(spark, sf_dir)
    a = atoms.select("mol_id", F.col("atom_id").alias("src"))
    b = atoms.select("mol_id", F.col("atom_id").alias("dst"))
    fwd = a.withColumn("dst", F.col("src") + 1).join(b, ["mol_id", "dst"], "inner")
    rev = fwd.select("mol_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = fwd.select("mol_id", "src", "dst").unionByName(rev)
    return both.withColumn("bond_type", ((F.col("src") + F.col("dst")) % 3).cast("int"))


#: Atoms that share one copy of each vector.
NODE_BLOCK = 200_000


# ---------------------------------------------------------------- FX-FEAT / FX-TEXTFEAT / FX-NODES
FX_FEAT_SQL = (
    f"SELECT p.*, f.qty, f.disc, f.tax FROM ({FX_PRED_SQL}) p JOIN (SELECT l_orderkey, "
    "sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY l_orderkey) f "
    "ON p.row_id = f.l_orderkey")
FX_TEXTFEAT_SQL = "SELECT doc_id AS row_id, text AS smiles, CAST(length(text) AS DOUBLE) AS label FROM documents"


def fx_feat(spark, sf_dir) -> DataFrame:
    """fx_pred joined with per-order line aggregates (features for the regressors)."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    return fx_pred(spark, sf_dir).join(f, "row_id", "inner")


def fx_textfeat(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("smiles"),
                    F.length("text").cast("double").alias("label"))


def fx_nodes(spark, sf_dir) -> DataFrame:
    """(block, mol_id, atom_id, vec ARRAY<FLOAT>): one 64-value vector per atom, from the embeddings table.

    Molecules are dealt to blocks of about ``NODE_BLOCK`` atoms, or three atoms for each embeddings row if that is more, and
    a block gets each vector that its atoms need once: vectors cross the network per block, not per atom.  Both sides of
    the join are dealt by block, so a readout by (block, mol_id) finds its rows in place.
    """
    li = table(spark, sf_dir, "lineitem")
    e = table(spark, sf_dir, "embeddings")
    # atoms are dealt over all embeddings rows, so no key gets more than its share as the table grows
    n = max(1, e.count())
    blocks = max(spark.sparkContext.defaultParallelism, li.count() // max(NODE_BLOCK, 3 * n))
    parts = 3 * blocks  # so that few tasks get several blocks
    # both sides of the join below are dealt by block, one of its two keys: without this Spark would deal them anew by both
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    atoms = li.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(blocks)).alias("block"), F.col("l_orderkey").alias("mol_id"),
                      F.col("l_linenumber").alias("atom_id")).repartition(parts, "block").distinct()
    keyed = atoms.withColumn("vec_id", ((F.col("mol_id") * 7 + F.col("atom_id")) % n).cast("bigint"))
    vectors = e.select("vec_id", F.col("embedding").alias("vec"))
    needed = keyed.select("block", "vec_id").distinct().join(vectors, "vec_id").repartition(parts, "block")
    return keyed.join(needed, ["block", "vec_id"]).drop("vec_id")


FX_NODES_SQL = (
    f"SELECT a.mol_id, a.atom_id, e.embedding AS vec FROM ({FX_ATOMS_SQL}) a "
    "JOIN embeddings e ON (a.mol_id * 7 + a.atom_id) % (SELECT count(*) FROM embeddings) = e.vec_id")


# ---------------------------------------------------------------- FX-SIGMA
SIGMA_COLS = [f"S{i}" for i in range(1, 11)]
FX_SIGMA_SQL = ("SELECT vec_id AS row_id, "
                + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS S{i}" for i in range(1, 11))
                + ", 273.15 + CAST(label AS DOUBLE) AS temp FROM embeddings")


def fx_sigma(spark, sf_dir) -> DataFrame:
    """(row_id, S1..S10, temp): ten profile columns and a temperature from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.element_at("embedding", i).cast("double").alias(f"S{i}") for i in range(1, 11)]
    return e.select(F.col("vec_id").alias("row_id"), *cols,
                    (F.lit(273.15) + F.col("label").cast("double")).alias("temp"))


# ---------------------------------------------------------------- FX-WORDVEC
FX_WORDVEC_SQL = f"""
WITH w AS (SELECT unnest(string_split(smiles, ' ')) AS word FROM ({FX_DOC_SQL}) d),
     c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' AND word <> 'UNK' GROUP BY word),
     r AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS vec_id FROM c)
SELECT r.word, e.embedding AS vec FROM r JOIN embeddings e ON r.vec_id = e.vec_id
UNION ALL SELECT 'UNK' AS word, embedding AS vec FROM embeddings WHERE vec_id = 0"""


def word_table(words: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, vec): the word of rank k by count, then by name, gets the embeddings row k; ``UNK`` gets row 0.

    Every embeddings row after the first is used as long as there are words; ranks come from one sorted pass.
    """
    counts = words.where((F.col("word") != "") & (F.col("word") != "UNK")).groupBy("word").agg(F.count("*").alias("n"))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("word").asc()], "r", keep=["word"])
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vec"))
    vocab = ranked.select("word", (F.col("r") + 1).alias("vec_id")).join(e, "vec_id", "inner").select("word", "vec")
    return vocab.unionByName(e.where(F.col("vec_id") == 0).select(F.lit("UNK").alias("word"), "vec"))


def fx_wordvec(spark, sf_dir) -> DataFrame:
    """The word table of the documents' space-separated words."""
    words = fx_doc(spark, sf_dir).select(F.explode(F.split("smiles", " ")).alias("word"))
    return word_table(words, table(spark, sf_dir, "embeddings"))
