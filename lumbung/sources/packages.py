"""Planning packages and acquired pages as Spark inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.numbers import money
from lumbung.schemas import PACKAGES, PAGES


def read_packages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Packages under the enforced schema; files that lack one of its columns are refused."""
    missing = set(PACKAGES.fieldNames()) - set(spark.read.format(fmt).load(path).columns)
    if missing:
        raise ValueError(f"packages lack columns: {', '.join(sorted(missing))}")
    return spark.read.format(fmt).schema(PACKAGES).load(path)


def plan_candidates(packages: DataFrame, source_year: int, provenance: Column,
                    limit: int | None = None) -> DataFrame:
    """Packages as plan candidates ordered by id, budgets exact; see ``unusable_packages``."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be a positive integer")
    rows = packages.orderBy("id") if limit is None else packages.orderBy("id").limit(limit)
    key = F.col("id").cast("string")
    return rows.select(
        key.alias("planned_procurement_id"), key.alias("source_rup_id"),
        F.col("idSatker").cast("string").alias("id_satker"), F.col("idKldi").alias("id_kldi"),
        F.col("satuanKerja").alias("institution_name"), F.col("kldi").alias("kldi_name"),
        F.col("paket").alias("package_title"), money(F.col("pagu")).alias("budget"),
        F.col("jenisPengadaan").alias("procurement_type"),
        F.col("metode").alias("procurement_method"),
        F.col("pemilihan").alias("selection_period"), F.col("lokasi").alias("location"),
        F.lit(source_year).alias("source_year"), provenance.alias("provenance"))


def unusable_packages(packages: DataFrame) -> DataFrame:
    """Packages lacking an identity or contract field, with the names of what is missing."""
    needed = ["id", "id_referensi", "idSatker", "idKldi", "satuanKerja", "kldi", "paket",
              "jenisPengadaan", "metode", "pemilihan", "lokasi"]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    return packages.select("id", missing.alias("missing")).where(F.size("missing") > 0)


def require_usable(packages: DataFrame) -> DataFrame:
    """The packages, failing the job on the first row that cannot keep its contract."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (
        "id", "id_referensi", "idSatker", "idKldi", "satuanKerja", "kldi", "paket")]))
    guard = F.when(F.size(bad) > 0, F.raise_error(F.concat(
        F.lit("row is missing required fields: "), F.array_join(bad, ", "))).cast("long"))
    return packages.withColumn("id", F.coalesce(guard, F.col("id")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page envelopes, one JSON object per line; the payload stays text until it is checked."""
    return spark.read.schema(PAGES).json(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(path)
