"""Stateless row operators on a streaming DataFrame.

The reference is batch-only; these functions only show that the row-level operators (validation,
fingerprints, split filters) are plain projections and filters and therefore run unchanged on
``readStream`` input.  No state, watermark or window is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.operators import relational as rel
from solvara.operators.similarity import lingo_fingerprint


def read_molecule_stream(spark: SparkSession, path: str, schema: str = "row_id bigint, smiles string",
                         max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream of ``(row_id, smiles)`` rows."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path).select("row_id", "smiles"))


def featurize_stream(stream: DataFrame, q: int = 4, n_bits: int = 512) -> DataFrame:
    """Validate each arriving row (P8) and fingerprint the good ones (F1); rejects keep their reason."""
    good, _ = rel.validate(stream, "smiles")
    bits = lingo_fingerprint(good, "smiles", q, n_bits)
    return bits.select("row_id", F.size("bits").alias("n_set"), "bits")


def start_featurize(stream: DataFrame, out_path: str, checkpoint: str, q: int = 4, n_bits: int = 512):
    """Start the query writing fingerprints to parquet (exactly-once via the checkpoint folder)."""
    return (featurize_stream(stream, q, n_bits).writeStream.format("parquet")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .outputMode("append").start())
