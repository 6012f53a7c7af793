"""solvara: Spark-native preparation, splitting and evaluation of molecular property tables.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL expressions,
joins and aggregates.  Rows carry an explicit key (``row_id`` by default) so results never
depend on partitioning.  The most used operators are re-exported here.
"""

from solvara.session import get_spark, ensure_checkpoint_dir, write_once
from solvara.operators.similarity import lingo_fingerprint, complementary_similarity, isim, medoid, outlier
from solvara.operators.sampling import stratified_sample, quota_sample, three_way_split, hash_split, k_fold
from solvara.operators.metrics import (regression_metrics, compute_metrics, calibration_area, nll, ence,
                                       fit_z_scaling, apply_z_scaling, uncertainty_error_spearman)
from solvara.operators.vectors import sentence_vectors, lookup_vectors, readout
from solvara.operators.graph import circular_fingerprint, identifier_sentences

__all__ = [
    "get_spark", "ensure_checkpoint_dir", "write_once",
    "lingo_fingerprint", "complementary_similarity", "isim", "medoid", "outlier",
    "stratified_sample", "quota_sample", "three_way_split", "hash_split", "k_fold",
    "regression_metrics", "compute_metrics", "calibration_area", "nll", "ence",
    "fit_z_scaling", "apply_z_scaling", "uncertainty_error_spearman",
    "sentence_vectors", "lookup_vectors", "readout",
    "circular_fingerprint", "identifier_sentences",
]
