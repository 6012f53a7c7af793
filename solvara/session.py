"""Session set-up and the few execution helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "solvara",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    On a cluster the master and the checkpoint folder come from the launcher; locally
    ``master`` defaults to ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files are deleted once the DataFrame that wrote them is garbage collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only for a ``local`` master.

    On a cluster the setting must name a shared folder: a machine-local one would be seen by one machine only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="solvara-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint directory; deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/solvara-io/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def write_once(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as parquet below the shared folder and return the reread table.

    Used where later passes must see identical rows, or would otherwise repeat the work.  Unlike a row
    checkpoint the reread table keeps column pruning, filter pushdown and size statistics, so Spark itself
    decides whether a side is small enough to broadcast.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go: Spark removes them once the driver's garbage collector finds them unused.

    A driver with little to do collects seldom, and every step's files would stay beside those of the next.
    """
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, for operators that run Python in their tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='solvara-package-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(archive)  # goes to the driver's file server, from which executors fetch it
    _SHIPPED.add(sc.applicationId)


def scale_settings(input_bytes: int, target_partition_bytes: int = 256 << 20,
                   max_split_bytes: int = 256 << 20) -> dict:
    """Settings that keep shuffle and scan partitions near ``target_partition_bytes`` at a given scale.

    AQE coalesces small partitions at run time but never splits an aggregate's partition, so the
    starting shuffle width must be large enough for the biggest stage: one partition per target size of
    input (e.g. ~400k for 100 TB at 256 MB), never below 200.  Scans are split at ``max_split_bytes``.
    """
    width = max(200, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(width),
        "spark.sql.files.maxPartitionBytes": str(int(max_split_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
