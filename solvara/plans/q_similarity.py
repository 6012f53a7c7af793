"""Registered queries: fingerprints, similarity, sampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import ranking, sampling, similarity
from solvara.plans import fixtures as fx
from solvara.plans import oracle as orc
from solvara.plans.registry import register
from solvara.session import write_once

Q, NBITS = 4, 512


def _bits(spark, sf_dir, n_bits=NBITS, keep=True):
    """Fingerprints of the documents; written to the checkpoint folder once when read by several passes."""
    b = similarity.lingo_fingerprint(fx.fx_doc(spark, sf_dir), "smiles", Q, n_bits)
    return write_once(b) if keep else b


@register("f1_lingo_fingerprint", orc.with_bits(
    "SELECT row_id, CAST(len(bits) AS INTEGER) AS n_set, array_to_string(bits, ',') AS bits_text FROM bits"))
def f1_lingo_fingerprint(spark, sf_dir):
    b = _bits(spark, sf_dir, keep=False)
    return b.select("row_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits_text"))


@register("f1_lingo_fingerprint_256", orc.with_bits(
    "SELECT row_id, CAST(len(bits) AS INTEGER) AS n_set, array_to_string(bits, ',') AS bits_text FROM bits",
    n_bits=256))
def f1_lingo_fingerprint_256(spark, sf_dir):
    b = _bits(spark, sf_dir, 256, keep=False)
    return b.select("row_id", F.size("bits").alias("n_set"), F.array_join("bits", ",").alias("bits_text"))


@register("f4_complementary_similarity", orc.with_bits("SELECT row_id, comp_sim FROM cs"))
def f4_complementary_similarity(spark, sf_dir):
    return similarity.complementary_similarity(_bits(spark, sf_dir), NBITS)


@register("f5_stratified_sample_80", orc.with_bits(f"SELECT row_id FROM ({orc.stratified_sql('cs', 80)}) s"))
def f5_stratified_sample_80(spark, sf_dir):
    cs = similarity.complementary_similarity(_bits(spark, sf_dir), NBITS)
    return sampling.stratified_sample(cs, 80)


@register("f6_quota_sample_90", orc.with_bits(f"SELECT row_id FROM ({orc.quota_sql('cs', 90)}) s"))
def f6_quota_sample_90(spark, sf_dir):
    cs = similarity.complementary_similarity(_bits(spark, sf_dir), NBITS)
    return sampling.quota_sample(cs, 90)


@register("f7_split_stratified_70_10_20", orc.three_way_split_sql("stratified", 80, 87.5))
def f7_split_stratified(spark, sf_dir):
    return sampling.three_way_split(_bits(spark, sf_dir, keep=False), NBITS, "stratified", 80, 87.5)


@register("f7_split_quota_85_5_10", orc.three_way_split_sql("quota", 90, 94.45))
def f7_split_quota(spark, sf_dir):
    return sampling.three_way_split(_bits(spark, sf_dir, keep=False), NBITS, "quota", 90, 94.45)


SPLIT_COUNTS_SQL = (f"SELECT split, count(*) AS n_rows FROM ({orc.three_way_split_sql('stratified', 80, 87.5)}) t "
                    "GROUP BY split")


@register("f7_split_counts", SPLIT_COUNTS_SQL)
def f7_split_counts(spark, sf_dir):
    """Minimum slice: rows per split when splitting 70/10/20 by structural diversity."""
    split = sampling.three_way_split(_bits(spark, sf_dir, keep=False), NBITS, "stratified", 80, 87.5)
    return split.groupBy("split").agg(F.count("*").alias("n_rows"))


@register("f8_isim", orc.with_bits(
    "SELECT n AS n_rows, CAST(a AS DECIMAL(38,0)) AS a_pairs, CAST(d AS DECIMAL(38,0)) AS d_pairs, "
    "CASE WHEN a + d = 0 THEN 0.0 ELSE CAST(a AS DOUBLE) / CAST(a + d AS DOUBLE) END AS isim FROM ("
    "SELECT (SELECT count(*) FROM bits) AS n, "
    "coalesce(sum(CAST(k AS HUGEINT) * (k - 1) // 2), 0) AS a, "
    "coalesce(sum(CAST(k AS HUGEINT) * ((SELECT count(*) FROM bits) - k)), 0) AS d "
    "FROM (SELECT bit, count(*) AS k FROM (SELECT unnest(bits) AS bit FROM bits) u GROUP BY bit) kk) t"))
def f8_isim(spark, sf_dir):
    return similarity.isim(_bits(spark, sf_dir), NBITS)


@register("f9_medoid", orc.with_bits("SELECT row_id, comp_sim FROM cs ORDER BY comp_sim, row_id LIMIT 1"))
def f9_medoid(spark, sf_dir):
    return similarity.medoid(_bits(spark, sf_dir), NBITS)


@register("f10_outlier", orc.with_bits("SELECT row_id, comp_sim FROM cs ORDER BY comp_sim DESC, row_id LIMIT 1"))
def f10_outlier(spark, sf_dir):
    return similarity.outlier(_bits(spark, sf_dir), NBITS)


@register("w1_global_rank", orc.with_bits(
    "SELECT row_id, row_number() OVER (ORDER BY comp_sim, row_id) - 1 AS rank FROM cs"))
def w1_global_rank(spark, sf_dir):
    cs = similarity.complementary_similarity(_bits(spark, sf_dir), NBITS)
    return ranking.global_rank(cs, ["comp_sim", "row_id"]).select("row_id", "rank")


# Hash split and k-fold over the prediction table keys
_W = [70, 10, 20]
_U = "CAST(('0x' || substr(md5('536|' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"


def _hash_split_sql():
    tot = float(sum(_W))
    c1, c2 = _W[0] / tot, (_W[0] + _W[1]) / tot
    return (f"SELECT row_id, CASE WHEN {_U} < CAST({c1!r} AS DOUBLE) THEN 'Training' "
            f"WHEN {_U} < CAST({c2!r} AS DOUBLE) THEN 'Validation' "
            f"ELSE 'Testing' END AS split FROM ({fx.FX_PRED_SQL}) p")


@register("l12_hash_split", _hash_split_sql())
def l12_hash_split(spark, sf_dir):
    p = fx.fx_pred(spark, sf_dir).select("row_id")
    return sampling.hash_split(p, "row_id", _W, 536, labels=["Training", "Validation", "Testing"])


@register("l12_k_fold", "SELECT row_id, CAST(('0x' || substr(md5('536|' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT "
                        f"% 5 AS INTEGER) AS fold FROM ({fx.FX_PRED_SQL}) p")
def l12_k_fold(spark, sf_dir):
    return sampling.k_fold(fx.fx_pred(spark, sf_dir).select("row_id"), "row_id", 5, 536)
