"""Helpers shared by the operators: shared-folder files, the held-out rule, bounded label samples."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to a Python worker; documents are long, so batches are kept short.
ARROW_ROWS = 1000
#: Most labelled rows a model is fitted on (chosen by hash, so the choice does not depend on partitioning).
FIT_ROWS = 8_000
_SHIPPED: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, deleted when the application ends.

    Off ``local`` masters the setting is required: a machine-local folder would not be seen by every executor.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            configured = tempfile.mkdtemp(prefix="solvara-llm-")
        sc.setCheckpointDir(configured)
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table (cuts lineage, keeps pruning)."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_tasks(spark: SparkSession) -> None:
    """Get Python workers ready: short Arrow batches (texts are long) and this package shipped to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='solvara-py-')}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, str(f.relative_to(package.parent)))
        sc.addPyFile(archive)  # copied to the driver's file server, from which executors fetch it
        _SHIPPED.add(sc.applicationId)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: a non-null id outside the held-out quarter."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def fit_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``(text, label)`` of at most ``rows`` labelled, learnable documents, the same ones for any partitioning.

    The bound is a documented parameter of the fit; the id list is therefore at most ``rows`` long and may be
    broadcast.  Ids or labels that are null are left out; an id labelled twice counts once (its smallest label), and so
    does one that several rows of ``documents`` have (its smallest text).
    """
    chosen = (labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
              .where(learnable(F.col("__id")) & F.col("label").isNotNull())
              .groupBy("__id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(rows))
    texts = documents.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    return (texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
            .select("text", "label"))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
