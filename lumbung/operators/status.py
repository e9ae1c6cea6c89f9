"""Status, source-type, product-category, stage and verification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.matching import matching_terms
from lumbung.functions.text import contains_any, first_class, normalize
from lumbung.functions.web import is_email
from lumbung.rules import evidence as E
from lumbung.rules import outreach as R


def factual_status(text: Column) -> Column:
    """Observed status named by a text; null when none is."""
    return first_class(F.lower(F.coalesce(text, F.lit(""))), E.FACTUAL_STATUS, None)


def source_type(file_name: Column, header: Column, text: Column) -> Column:
    combined = F.lower(F.concat_ws(" ", file_name, header, text))
    return first_class(combined, E.SOURCE_TYPES, E.SOURCE_TYPE_DEFAULT)


def procurement_status(source_status: Column) -> Column:
    """Status class of an accepted candidate's source status."""
    return first_class(normalize(source_status), E.PROCUREMENT_STATUS, E.PROCUREMENT_STATUS_OTHER)


def has_status_terms(text: Column) -> Column:
    return contains_any(F.lower(text), E.STATUS_TERMS)


def tag_target_keywords(evidence: DataFrame, fields: list[str],
                        keywords: list[str] | None = None) -> DataFrame:
    """Keep rows whose text holds a target keyword; the first in list order is the primary."""
    keywords = keywords or E.TARGET_KEYWORDS
    text = normalize(F.concat_ws(" ", *[F.col(c) for c in fields]))
    tagged = evidence.withColumn("_text", text).withColumn(
        "_hits", matching_terms(keywords, lambda k: F.col("_text").contains(k)))
    return tagged.where(F.size("_hits") > 0).withColumn("keyword", F.get("_hits", F.lit(0))) \
        .withColumn("matched_keywords", F.array_join("_hits", ";")).drop("_text", "_hits")


def product_category(text: Column) -> Column:
    return first_class(F.lower(text), R.PRODUCT_CATEGORY_TERMS, R.PRODUCT_CATEGORY_DEFAULT)


def verification_code(expected_id: Column) -> Column:
    """First failing check of a prospect's contact verification; "OK" when all hold."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    status = F.upper(text("contact_verification_status"))
    contact = F.upper(text("contact_status"))
    return (
        F.when(~F.col("institution_id").eqNullSafe(expected_id), "CONTACT_INSTITUTION_MISMATCH")
        .when(~is_email(F.col("contact_email")), "CONTACT_EMAIL_INVALID")
        .when(text("contact_source_url") == "", "CONTACT_SOURCE_MISSING")
        .when(contact == "CONTACT_NEEDS_REVIEW", "CONTACT_NEEDS_REVIEW")
        .when(contact != "CONTACT_FOUND", "CONTACT_STATUS_NOT_VERIFIED")
        .when(status == "", "CONTACT_VERIFICATION_MISSING")
        .when(status != "VERIFIED", F.concat(F.lit("CONTACT_"), status))
        .when((text("contact_verified_at") == "") | (text("contact_verified_by") == "")
              | (text("contact_verification_source") == ""), "CONTACT_VERIFICATION_INCOMPLETE")
        .otherwise("OK"))


def outreach_stage(draft: str = "draft", status: str = "outreach_status") -> Column:
    """Stage from the workflow draft first, then from the status text; null when there is none."""
    d = F.col(draft)
    text = F.upper(F.coalesce(F.col(status), F.lit("")))
    return (
        F.when(d["sent"], "Sent").when(d["ready_to_send"], "Ready to Send")
        .when(d["approved"], "Approved").when(d["status"] == "UNDER_REVIEW", "Under Review")
        .when(d["status"].isin(R.DRAFT_WORK_STATES), "Drafts")
        .when(text.contains("FAILED"), "Failed").when(text == "SENT", "Sent")
        .when(text == "READY_TO_SEND", "Ready to Send").when(text == "APPROVED", "Approved")
        .when(text == "UNDER_REVIEW", "Under Review").when(text.contains("DRAFT"), "Drafts"))


def label_table(spark, labels: dict[str, str] | None = None) -> DataFrame:
    """Status labels as a table (fixed size, one row per known status)."""
    return spark.createDataFrame(list((labels or R.STATUS_LABELS).items()),
                                 "status string, label string")


def with_label(df: DataFrame, column: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Display label of a status; unknown statuses show themselves, missing ones a placeholder."""
    names = F.broadcast(label_table(df.sparkSession, labels).withColumnRenamed("status", column))
    joined = df.join(names, column, "left")
    value = F.col(column)
    return joined.withColumn("label", F.when(
        F.coalesce(value, F.lit("")) == "", R.UNKNOWN_STATUS_LABEL).otherwise(
        F.coalesce("label", value)))
