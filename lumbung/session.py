"""Session settings and the places where intermediate tables may be written."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on; sizes (memory, cores, partitions) belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: str = "8", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need it wherever the driver was started."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumbung-code-"), "lumbung")
    spark.sparkContext.addPyFile(shutil.make_archive(
        archive, "zip", os.path.dirname(package), os.path.basename(package)))


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local
    folder would be lost with its executor, so a missing setting is an error there.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        current = os.path.join(tempfile.mkdtemp(prefix="lumbung-"), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that loops do not grow their plans."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


FEW_ROWS = 20_000  # rows of a narrow table that may be sent to every task, after counting


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """A stored narrow table, sent to every task when it was counted to be small.

    Stored tables have no size estimate, so without this the larger side of a join would move.
    """
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df
