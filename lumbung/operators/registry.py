"""Portal registry: inference from names, summaries and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.ranking import one_per_group
from lumbung.functions.text import squeeze, yes_like
from lumbung.functions.web import portal_base, portal_slug
from lumbung.rules import registry as R


def category(name: Column) -> Column:
    text = F.lower(squeeze(name))
    rule = None
    for needle, label in R.CATEGORIES:
        hit = text.contains(needle.lower())
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    return rule


def province(text: Column) -> Column:
    """The longest province name the text holds."""
    lowered = F.lower(text)
    ordered = sorted(R.PROVINCES, key=len, reverse=True)
    return F.coalesce(*[F.when(lowered.contains(p.lower()), F.lit(p)) for p in ordered])


def regency(name: Column) -> Column:
    lowered = F.lower(name)
    return F.when(lowered.contains("kabupaten") | lowered.contains("kota"),
                  F.nullif(squeeze(name), F.lit("")))


def software_version(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit(""))
             for p in R.VERSION_PATTERNS]
    return F.concat(F.lit("v"), F.coalesce(*found))


def distinct_rows(rows: DataFrame, position: str) -> DataFrame:
    """First row per (page, name, province); missing values count as equal."""
    return one_per_group(rows, ["source_page", "nama_lpse", "provinsi"], F.col(position))


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Detail-page fields override card fields; ``details`` has one row per ``source_page``."""
    d = details.select("source_page", F.nullif(F.col("province"), F.lit("")).alias("d_province"),
                       F.nullif(F.col("url"), F.lit("")).alias("d_url"),
                       F.nullif(F.col("server_status"), F.lit("")).alias("d_status"))
    joined = rows.join(d, "source_page", "left")
    url = F.col("d_url")
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return joined.withColumns({
        "provinsi": F.coalesce("d_province", "provinsi"),
        "official_lpse_url": F.coalesce(url, F.col("official_lpse_url")),
        "domain": F.coalesce(host, F.col("domain")),
        "https": F.when(url.isNotNull() & (scheme != ""), scheme == "https").otherwise(
            F.col("https")),
        "source_note": F.when(F.col("d_status").isNotNull(), F.concat(
            "source_note", F.lit("; server_status="), "d_status")).otherwise(
            F.col("source_note")),
    }).select(*rows.columns)


def summary(rows: DataFrame) -> DataFrame:
    """Tallies; an unknown flag counts on neither side."""
    def yes(c: str) -> Column:
        return F.count_if(F.col(c))

    def no(c: str) -> Column:
        return F.count_if(~F.col(c))

    versions = F.nullif(F.trim("versi_spse"), F.lit(""))
    return rows.agg(
        F.count("*").alias("total"), yes("aktif").alias("active"), no("aktif").alias("inactive"),
        yes("https").alias("https"), no("https").alias("http"),
        yes("dapat_diakses").alias("accessible"), no("dapat_diakses").alias("inaccessible"),
        F.array_join(F.array_sort(F.collect_set(versions)), "; ").alias("versions"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("null")).alias(column)).agg(
        F.count("*").alias("rows"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def quality_flags(rows: DataFrame) -> DataFrame:
    named = province(F.col("nama_lpse"))
    flags = {
        "province_mismatch_suspected": F.coalesce(
            F.lower(named) != F.lower("provinsi"), F.lit(False)),
        "missing_official_url": _blank("official_lpse_url"),
        "missing_domain": _blank("domain"),
        "missing_spse_version": _blank("versi_spse"),
        "inactive_or_inaccessible": ~F.coalesce("aktif", F.lit(False))
        | ~F.coalesce("dapat_diakses", F.lit(False)),
    }
    out = rows.withColumn("province_mentioned_in_name", named).withColumns(flags)
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in R.QUALITY_FLAGS]))
    return out.withColumn("quality_flags", names).withColumn(
        "quality_flag_count", F.size("quality_flags"))


def quality_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("quality_flag_count") > 0).alias("flagged_rows"),
        *[F.count_if(F.col(f)).alias(f) for f in R.QUALITY_FLAGS])


def selectable_portals(rows: DataFrame, position: str, limit: int | None = None) -> DataFrame:
    """Portals to read from: uses the software, reachable if any is, usable address, distinct."""
    users = rows.where(yes_like(F.col("menggunakan_spse")))
    reachable = yes_like(F.col("dapat_diakses"))
    any_reachable = users.agg(F.count_if(reachable) > 0).scalar()
    chosen = users.where(reachable | ~any_reachable).withColumn(
        "official_lpse_url", F.trim(F.coalesce("official_lpse_url", F.lit(""))))
    chosen = chosen.withColumn("slug", portal_slug(F.col("official_lpse_url"))).withColumn(
        "base_lpse_url", portal_base(F.col("official_lpse_url")))
    chosen = chosen.where((F.col("official_lpse_url") != "") & F.col("slug").isNotNull())
    distinct = one_per_group(chosen, ["base_lpse_url", "nama_lpse"], F.col(position))
    ordered = distinct.orderBy("nama_lpse", "official_lpse_url", position)
    return ordered if limit is None else ordered.limit(limit)


def routed_portal(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Registry rows of explicit active routes; a route naming several rows names none."""
    counts = rows.groupBy(F.trim("official_lpse_url").alias("route_url")).agg(
        F.count("*").alias("n"))
    usable = routes.join(counts.where("n = 1"), "route_url", "left_semi")
    return rows.join(usable, F.trim("official_lpse_url") == F.col("route_url"))
