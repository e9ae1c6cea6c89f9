"""Parameterised filters over packages, institutions, queues and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.text import split_list

ALL = "ALL"


def _text(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit(""))
                                      for n in names]))


def packages_where(packages: DataFrame, year: int | None = None, keyword: str | None = None,
                   institution: str | None = None, package_name: str | None = None,
                   month: int | None = None) -> DataFrame:
    """AND of the given predicates; text arguments are patterns on lower-case text."""
    out = packages
    if year:
        out = out.where(_text("pemilihan").rlike(str(year)))
    if keyword:
        out = out.where(_text("paket", "jenisPengadaan", "metode").rlike(keyword.lower()))
    if institution:
        out = out.where(_text("satuanKerja", "kldi").rlike(institution.lower()))
    if package_name:
        out = out.where(_text("paket").rlike(package_name.lower()))
    if month:
        out = out.where((F.col("idBulan") == month) | _text("pemilihan").rlike(str(month)))
    return out


def packages_of_year(packages: DataFrame, year: int) -> DataFrame:
    """Year mentioned in the period, title, unit or agency."""
    return packages.where(_text("pemilihan", "paket", "satuanKerja", "kldi").rlike(str(year)))


def has_email() -> Column:
    return F.trim(F.coalesce("contact_email", F.lit(""))) != ""


def contact_order(position: str) -> list[Column]:
    """Institutions with an e-mail first, otherwise as they came."""
    return [F.when(has_email(), 0).otherwise(1), F.col(position)]


def search_institutions(institutions: DataFrame, contact: str = ALL, evidence: str = ALL,
                        text: str = "") -> DataFrame:
    out = institutions
    if contact == "FOUND":
        out = out.where(has_email())
    elif contact == "MISSING":
        out = out.where(~has_email())
    if evidence != ALL:
        out = out.where(F.col("evidence_status") == evidence)
    if text.strip():
        fields = ["institution_display_name", "institution_name", "parent_organization",
                  "work_unit", "province_or_region", "location_hint", "relevant_categories",
                  "contact_email"]
        out = out.where(_text(*fields).contains(text.strip().lower()))
    return out


def queue_where(prospects: DataFrame, month: str = ALL, text: str = "", category: str = ALL,
                target_level: str = ALL, contact_status: str = ALL, send_readiness: str = ALL,
                outreach_status: str = ALL, operational: str = ALL,
                effective_status: str = "outreach_status") -> DataFrame:
    """Prospect queue: up to nine facets; ``effective_status`` names the status column used."""
    out = prospects
    status = F.col(effective_status)
    if month != ALL:
        out = out.where(F.col("months_found").contains(month))
    if text.strip():
        fields = ["institution_display_name", "institution_name", "parent_organization",
                  "work_unit", "location_hint", "province_or_region", "relevant_categories",
                  "contact_email"]
        out = out.where(_text(*fields).contains(text.strip().lower()))
    if category != ALL:
        out = out.where(F.array_contains(split_list(F.col("relevant_categories")), category))
    for column, wanted in (("target_level", target_level), ("contact_status", contact_status),
                           ("send_readiness", send_readiness)):
        if wanted != ALL:
            out = out.where(F.col(column) == wanted)
    if outreach_status != ALL:
        out = out.where(status == outreach_status)
    if operational == "CONTACT_FOUND":
        out = out.where(has_email())
    elif operational == "READY_FOR_DRAFT":
        out = out.where(has_email() & status.isin("NOT_CONTACTED", ""))
    elif operational == "READY_TO_SEND":
        out = out.where(status == "READY_TO_SEND")
    return out


def products_where(products: DataFrame, provider: str = ALL, brand: str = ALL,
                   category: str = ALL, status: str = ALL, text: str = "") -> DataFrame:
    out = products
    for column, wanted in (("provider", provider), ("brand", brand), ("category", category),
                           ("status", status)):
        if wanted != ALL:
            out = out.where(F.col(column) == wanted)
    if text.strip():
        haystack = F.lower(F.concat_ws(
            " ", "provider", "principal", "brand", "name", "category", "subcategory",
            F.array_join("keywords", " "), "status", "source", "evidence_status"))
        out = out.where(haystack.contains(text.strip().lower()))
    return out


def facet_values(df: DataFrame, column: str, separator: str | None = None) -> DataFrame:
    """Distinct values of a facet, of the list items where the column holds a joined list."""
    value = F.explode(split_list(F.col(column), separator)) if separator else F.col(column)
    return df.select(value.alias("value")).distinct()
