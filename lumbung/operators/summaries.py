"""KPI counts and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.numbers import money
from lumbung.functions.text import month_number
from lumbung.rules import outreach as R
from lumbung.rules.evidence import PLANNING_ONLY


def total(column: str) -> Column:
    return F.coalesce(F.sum(money(F.col(column))), F.lit(0)).cast("double")


def frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column in one pass; nulls are a value of their own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(
        F.count("*").alias("rows"))


def month_histogram(df: DataFrame, period: str) -> DataFrame:
    """Rows per month 1-12, months without rows included."""
    counts = df.select(month_number(F.col(period)).alias("month")).groupBy("month").agg(
        F.count("*").alias("n"))
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(counts, "month", "left").select(
        "month", F.coalesce("n", F.lit(0)).alias("rows"))


def crosscheck_summary(crosscheck: DataFrame) -> DataFrame:
    """Totals of a cross-check table, one row."""
    month = month_number(F.col("planned_month_or_date"))

    def in_months(*numbers: int) -> Column:
        return F.count_if(month.isin(*numbers))

    return crosscheck.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("evidence_source_type") != "NO_LOCAL_EVIDENCE").alias("with_evidence"),
        F.count_if(F.col("factual_status") == PLANNING_ONLY).alias("planning_only"),
        in_months(5).alias("may"), in_months(6).alias("june"),
        F.when(F.count("*") > 0, in_months(5, 6) / F.count("*")).otherwise(0.0).alias(
            "may_june_share"),
        in_months(1, 2, 3, 4).alias("jan_apr"),
        F.count_if(F.col("planned_month_or_date").contains("2025")).alias("mentions_2025"))


def keyword_hits(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """Rows holding each keyword, by hits then list position.

    One pass and one partial aggregation; keywords without a hit show only if none hits.
    """
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    hits = df.agg(*[F.count_if(text.contains(k)).alias(f"k{i}") for i, k in enumerate(keywords)])
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(i).alias("position"),
                              F.col(f"k{i}").alias("hits")) for i, k in enumerate(keywords)])
    table = hits.select(F.explode(rows).alias("r"), F.greatest(*[
        F.col(f"k{i}") for i in range(len(keywords))], F.lit(0)).alias("best")).where(
        (F.col("r.hits") > 0) | (F.col("best") == 0))
    return table.select("r.keyword", "r.position", "r.hits").orderBy(F.desc("hits"), "position")


def institution_kpis(prospects: DataFrame) -> DataFrame:
    return prospects.agg(
        F.count("*").alias("institutions"), total("total_pagu").alias("total_pagu"),
        F.count_if(F.trim("contact_email") != "").alias("contacts_found"),
        F.count_if(F.col("evidence_status") == PLANNING_ONLY).alias("planning_only"))


def queue_kpis(prospects: DataFrame) -> DataFrame:
    level, contact = F.col("target_level"), F.col("contact_status")
    return prospects.agg(
        F.count("*").alias("institutions"),
        F.count_if(level == "NATIONAL").alias("national"),
        F.count_if(level == "PROVINCE").alias("province"),
        F.count_if(level.isin("LOCAL_AGENCY", "HOSPITAL", "EDUCATION", "HEALTH_UNIT")).alias(
            "local_operational"),
        F.count_if(contact == "CONTACT_FOUND").alias("contact_found"),
        F.count_if(contact == "CONTACT_NEEDS_REVIEW").alias("contact_needs_review"),
        F.count_if(contact == "CONTACT_MISSING").alias("contact_missing"),
        F.count_if(F.col("send_readiness") == "NEEDS_REVIEW").alias("needs_review"),
        total("total_pagu").alias("total_pagu"))


def _contact_counts() -> list[Column]:
    contact = F.col("contact_status")
    return [F.count_if(contact == "CONTACT_FOUND").alias("found"),
            F.count_if(contact == "CONTACT_NEEDS_REVIEW").alias("needs_review"),
            F.count_if(contact == "CONTACT_MISSING").alias("missing")]


def _evidence_counts() -> list[Column]:
    return [F.count_if(F.col("evidence_status") == PLANNING_ONLY).alias("planning_only"),
            F.count_if(F.col("spse_status") == "SPSE_NOT_CHECKED_NATIONALLY").alias("not_checked")]


def contact_master_kpis(prospects: DataFrame) -> DataFrame:
    return prospects.agg(*_contact_counts())


def evidence_kpis(prospects: DataFrame) -> DataFrame:
    return prospects.agg(*_evidence_counts())


def contact_and_evidence_kpis(prospects: DataFrame) -> DataFrame:
    """Both in one pass."""
    return prospects.agg(*_contact_counts(), *_evidence_counts())


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def home_kpis(prospects: DataFrame) -> DataFrame:
    """Counts over outreach status and the joined workflow ``draft``."""
    status, draft = F.col("outreach_status"), F.col("draft")
    in_draft = status.contains("DRAFT")
    return prospects.agg(
        F.count("*").alias("institutions"),
        F.coalesce(F.sum("total_relevant_packages"), F.lit(0)).alias("needs"),
        F.count_if((status != "NOT_CONTACTED") | draft["updated_at"].isNotNull()).alias(
            "outreach"),
        F.count_if((status == "READY_TO_SEND") | _flag(draft["ready_to_send"])).alias(
            "ready_to_send"),
        F.count_if((status == "UNDER_REVIEW") | in_draft
                   | _flag(draft["status"] == "UNDER_REVIEW")).alias("waiting_approval"),
        F.count_if(in_draft | _flag(draft["status"].isin(R.DRAFT_WORK_STATES))).alias("drafts"),
        F.count_if((status == "SENT") | _flag(draft["sent"])).alias("follow_ups"))


def outreach_kpis(prospects: DataFrame) -> DataFrame:
    status, draft = F.col("outreach_status"), F.col("draft")
    return prospects.agg(
        F.count_if(status.contains("DRAFT") | _flag(draft["status"].isin(
            R.DRAFT_WORK_STATES))).alias("drafts"),
        F.count_if((status == "UNDER_REVIEW") | _flag(draft["status"] == "UNDER_REVIEW")).alias(
            "under_review"),
        F.count_if((status == "APPROVED") | _flag(draft["approved"])).alias("approved"),
        F.count_if((status == "READY_TO_SEND") | _flag(draft["ready_to_send"])).alias(
            "ready_to_send"),
        F.count_if((status == "SENT") | _flag(draft["sent"])).alias("sent"),
        F.count_if(status.contains("FAILED")).alias("failed"))


def stage_funnel(prospects: DataFrame, stage: str = "stage") -> DataFrame:
    """Rows per stage in the fixed stage order, zeros included."""
    names = prospects.sparkSession.createDataFrame(list(enumerate(R.STAGES)),
                                                   "position int, stage string")
    counts = prospects.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    return names.join(counts, "stage", "left").select(
        "position", "stage", F.coalesce("n", F.lit(0)).alias("institutions"))


def contact_match_counts(enriched: DataFrame) -> DataFrame:
    kind = F.col("contact_match_type")
    exact = kind.isin("exact_display_name", "work_unit_parent_organization")
    return enriched.agg(
        F.count("*").alias("rows"), F.count_if(kind != "unmatched").alias("matched"),
        F.count_if(exact).alias("exact"),
        F.count_if((kind != "unmatched") & ~exact).alias("other"),
        F.count_if(kind == "unmatched").alias("unmatched"))
