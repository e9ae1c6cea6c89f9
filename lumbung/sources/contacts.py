"""Contact files: header contracts, duplicate files and canonical contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions.numbers import confidence
from lumbung.functions.text import best_nonempty, display_name
from lumbung.functions.web import has_web_provenance
from lumbung.operators.authority import match_keys
from lumbung.rules import contacts as R
from lumbung.sources import delimited


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def equivalent_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Known files without byte-identical copies; same name with other bytes is an error.

    File contents are hashed by tasks; the driver only sees one row per file.
    """
    unknown = sorted({_name(p) for p in paths} - set(R.KNOWN_FILES))
    if unknown:
        raise ValueError(f"unknown contact source filename: {', '.join(unknown)}")
    files = spark.read.format("binaryFile").load(paths).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.sha2("content", 256).alias("sha"))
    rows = files.groupBy("name").agg(F.count_distinct("sha").alias("kinds"),
                                     F.min("path").alias("path")).collect()
    divergent = sorted(r["name"] for r in rows if r["kinds"] > 1)
    if divergent:
        raise ValueError(f"duplicate contact source conflict for {', '.join(divergent)}")
    return sorted(r["path"] for r in rows)


def read_contact_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one known file under its header contract, with their number as ``_record``."""
    name = _name(path)
    if name not in R.KNOWN_FILES:
        raise ValueError(f"unknown contact source filename: {name}")
    records = delimited.records(spark, path)
    header = records.where("record = 0").first()
    bare = delimited.header_names(header["text"]) if header else []
    rows = delimited.parsed(records.where("record > 0"), bare).drop("_path")
    missing = sorted(set(R.REQUIRED_COLUMNS[R.KNOWN_FILES[name][0]]) - set(bare))
    if missing:
        raise ValueError(f"unsupported schema for {name}; missing required columns: "
                         + ", ".join(missing))
    return rows


def canonical_contacts(rows: DataFrame, file_name: str, position: Column) -> DataFrame:
    """Rows of a layout as canonical contacts with score and natural keys."""
    layout, source_type, precedence = R.KNOWN_FILES[file_name]
    sources = R.FIELD_SOURCES[layout]

    def field(name: str) -> Column:
        return best_nonempty(*[F.col(f"`{c}`") for c in sources.get(name, [])
                               if c in rows.columns]) if sources.get(name) else F.lit("")

    score = confidence(field("confidence"))
    if "confidence_percent" in sources:
        score = F.when(score == 0, confidence(field("confidence_percent")) / 100.0).otherwise(
            score)
    url = field("contact_source_url")
    endpoint = field("endpoint_organization")
    out = rows.select(
        F.lit(file_name).alias("source_file"), F.lit(source_type).alias("source_type"),
        F.lit(precedence).alias("source_priority"), score.alias("source_confidence"),
        position.cast("long").alias("source_row"),
        *[field(f).alias(f) for f in ("institution_name", "parent_organization", "region",
                                      "contact_email", "official_website", "contact_phone",
                                      "contact_whatsapp", "contact_person", "contact_role",
                                      "contact_notes")],
        F.when(has_web_provenance(url), url).otherwise("").alias("contact_source_url"),
        F.lit(source_type).alias("contact_source_type"),
        endpoint.alias("endpoint_organization"),
        (endpoint != "").alias("endpoint_binding_explicit"))
    out = out.withColumn("work_unit", F.col("institution_name"))
    out = out.withColumn("institution_display_name", display_name(
        F.col("work_unit"), F.col("parent_organization")))
    filled = [F.when(F.col(c) != "", w).otherwise(0.0) for c, w in
              R.COMPLETENESS_WEIGHTS.items()]
    total = reduce(lambda a, b: a + b, filled) + F.col("source_confidence")
    return out.withColumn("completeness_score", total).withColumn("match_keys", match_keys())


def read_contacts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All known contact files as one canonical frame."""
    frames = []
    for path in equivalent_files(spark, paths):
        rows = read_contact_file(spark, path)
        frames.append(canonical_contacts(rows, _name(path), F.col("_record")))
    if not frames:
        raise FileNotFoundError("no contact sources given")
    return reduce(DataFrame.unionByName, frames)


def loose_contacts(rows: DataFrame, file_name: str) -> DataFrame | None:
    """A contact table with any accepted headers; None when it names no institution."""
    by_lower = {c.lower(): c for c in rows.columns}

    def source(names: list[str]) -> Column:
        found = next((by_lower[n] for n in names if n in by_lower), None)
        return F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")) if found else F.lit("")

    if not any(n in by_lower for n in R.LOOSE_COLUMNS["institution_name"]):
        return None
    return rows.select(*[source(names).alias(f) for f, names in R.LOOSE_COLUMNS.items()],
                       F.lit(file_name).alias("source_file"))
