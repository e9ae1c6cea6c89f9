"""Sinks: delimited files, sorted JSON lines with a digest, and digest-bound artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.digests import dataset_digest

HASH_ALGORITHM = "sha256"


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Flat columns only; arrays must be joined to text before."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option(
        "header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sidecar(df: DataFrame, path: str, order: list[str]) -> str:
    """JSON lines in the given total order (range-partitioned, no single task); its digest."""
    columns = sorted(df.columns)
    ordered = df.orderBy(*order).select(F.to_json(
        F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    ordered.write.mode("overwrite").text(path)
    return dataset_digest(df, columns).first()["digest"]


def artifact_metadata(df: DataFrame, artifact_id: str) -> dict[str, str]:
    digest = dataset_digest(df, sorted(df.columns)).first()["digest"]
    return {"registry_artifact_id": artifact_id, "registry_artifact_hash": digest,
            "registry_version": f"{HASH_ALGORITHM}:{digest}"}


def write_artifact(df: DataFrame, path: str, artifact_id: str) -> dict[str, str]:
    """Write a table and, next to it, the metadata that binds its content."""
    write_parquet(df, f"{path}/table")
    meta = artifact_metadata(df.sparkSession.read.parquet(f"{path}/table"), artifact_id)
    df.sparkSession.createDataFrame([meta]).write.mode("overwrite").json(f"{path}/metadata")
    return meta


def load_artifact(spark: SparkSession, path: str, artifact_id: str
                  ) -> tuple[DataFrame, dict[str, str]]:
    """The table and its metadata; refused when the stored metadata does not match the rows."""
    table = spark.read.parquet(f"{path}/table")
    stored = spark.read.json(f"{path}/metadata").first().asDict()
    if stored != artifact_metadata(table, artifact_id):
        raise ValueError("registry metadata does not match the registry artifact")
    return table, stored
