"""Prospects joined with imported contacts, workflow state and verifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.ranking import one_per_group
from lumbung.functions.web import contact_fingerprint, https_url, institution_id, normalize_email
from lumbung.rules import outreach as R


def to_prospects(rows: DataFrame) -> DataFrame:
    """Typed prospect rows: id from the exact name, numbers coerced, missing texts blank."""
    name = F.col("institution_name")
    texts = [c for c in rows.columns if c not in (
        "institution_name", "total_relevant_packages", "total_pagu")]
    shown = F.col("institution_display_name")
    return rows.select(
        institution_id(name).alias("institution_id"), name,
        *[F.when(F.coalesce(shown, F.lit("")) != "", shown).otherwise(name).alias(c)
          if c == "institution_display_name" else F.coalesce(F.col(c), F.lit("")).alias(c)
          for c in texts],
        F.coalesce(F.col("total_relevant_packages").cast("double"), F.lit(0.0)).cast(
            "long").alias("total_relevant_packages"),
        F.coalesce(F.col("total_pagu").cast("double"), F.lit(0.0)).alias("total_pagu"))


def merge_contacts(prospects: DataFrame, imported: DataFrame, position: str) -> DataFrame:
    """Contact import by exact name; of several rows for a name the last one counts."""
    fields = ["contact_email", "official_website", "contact_source_url",
              "contact_verification_status", "contact_verified_at", "contact_verified_by",
              "contact_verification_source"]
    rows = imported.withColumn("institution_name", F.trim("institution_name")).where(
        "institution_name <> ''")
    latest = one_per_group(rows.select("institution_name", position, *[
        F.trim(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in fields]),
        ["institution_name"], F.col(position), largest=True).drop(position)
    j = prospects.drop(*fields, "contact_status").join(latest, "institution_name", "left")
    value = {f: F.coalesce(f"_{f}", F.lit("")) for f in fields}
    status = (F.when((value["contact_email"] != "") & (value["contact_source_url"] != ""),
                     "CONTACT_FOUND")
              .when(value["contact_email"] != "", "CONTACT_NEEDS_REVIEW")
              .otherwise("CONTACT_MISSING"))
    return j.withColumn("contact_status", status).withColumns(value).drop(
        *[f"_{f}" for f in fields])


def _default_draft() -> Column:
    return F.struct(
        F.lit("NOT_GENERATED").alias("status"), F.lit("Not Generated").alias("review_status"),
        F.lit("").alias("text"), F.lit(False).alias("approved"),
        F.lit(False).alias("ready_to_send"), F.lit(False).alias("sent"),
        F.lit(None).cast("string").alias("updated_at"), F.lit(0).cast("long").alias("version"))


def with_workflow(prospects: DataFrame, drafts: DataFrame) -> DataFrame:
    """Add ``draft``; institutions without workflow state get the defaults."""
    defaults = _default_draft()
    names = ["status", "review_status", "text", "approved", "ready_to_send", "sent",
             "updated_at", "version"]
    j = prospects.join(drafts.withColumnRenamed("draft", "_draft"), "institution_id", "left")
    filled = F.struct(*[F.coalesce(F.col(f"_draft.{n}"), defaults[n]).alias(n) for n in names])
    return j.withColumn("draft", filled).drop("_draft")


def with_verification(prospects: DataFrame, verifications: DataFrame) -> DataFrame:
    """A verification applies only if id, fingerprint, e-mail and address all agree.

    ``verifications`` holds one current record per institution.
    """
    source = F.col("v.verification_source")
    v = verifications.alias("v")
    p = prospects.drop("contact_verification_status", "contact_verified_at",
                       "contact_verified_by", "contact_verification_source").alias("p")
    agrees = (
        (F.col("p.institution_id") == F.col("v.institution_id"))
        & (F.col("v.status") == "VERIFIED")
        & (contact_fingerprint(F.col("p.institution_id"), F.col("p.contact_email"),
                               F.col("p.contact_source_url"), source)
           == F.col("v.evidence_fingerprint"))
        & (normalize_email(F.col("p.contact_email")) == F.col("v.email"))
        & (https_url(F.col("p.contact_source_url")) == F.col("v.source_url")))
    j = p.join(v, agrees, "left")
    return j.select("p.*", *[F.coalesce(F.col(f"v.{c}"), F.lit("")).alias(n) for c, n in (
        ("status", "contact_verification_status"), ("verified_at", "contact_verified_at"),
        ("verified_by", "contact_verified_by"),
        ("verification_source", "contact_verification_source"))])


def apply_effective(prospects: DataFrame, effective: DataFrame) -> DataFrame:
    """Overlay the effective contact; a replacement also makes the contact found."""
    e = effective.select("institution_id", F.col("email").alias("_email"),
                         F.col("source_url").alias("_url"), F.col("kind").alias("_kind"))
    j = prospects.join(e, "institution_id", "left")
    return j.withColumns({
        "contact_status": F.when(F.col("_kind") == "REPLACEMENT", "CONTACT_FOUND").otherwise(
            F.col("contact_status")),
        "contact_email": F.coalesce("_email", "contact_email"),
        "contact_source_url": F.coalesce("_url", "contact_source_url"),
    }).drop("_email", "_url", "_kind")


def derived_events(status: Column) -> Column:
    """Timeline events an outreach status implies."""
    s = F.upper(F.coalesce(status, F.lit("")))
    closed = s.isin("CLOSED_WON", "CLOSED_LOST")
    late = s.isin("APPROVED", "READY_TO_SEND", "SENT")
    rules = {
        "COLD_EMAIL_DRAFTED": s.contains("DRAFT") | (s == "UNDER_REVIEW") | late | closed,
        "DRAFT_APPROVED": late | closed, "EMAIL_SENT": (s == "SENT") | closed,
        "CLOSED_WON": s == "CLOSED_WON", "CLOSED_LOST": s == "CLOSED_LOST"}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def timeline_label(status: Column) -> Column:
    """Label of the latest derived event in the fixed event order."""
    done = derived_events(status)
    latest = [F.when(F.array_contains(done, k), F.lit(label))
              for k, label in reversed(R.TIMELINE_EVENTS)]
    return F.coalesce(*latest, F.lit(R.NO_TIMELINE_LABEL))


def sent_projection(status: Column, sent_at: Column) -> Column:
    done = (status == "sent") & (F.coalesce(sent_at, F.lit("")) != "")
    return F.struct(done.alias("completed"), F.when(done, sent_at).alias("timestamp"))


def timeline_counts(prospects: DataFrame, recorded: str = "recorded_events") -> DataFrame:
    """Institutions per timeline event (derived or recorded), zeros included."""
    events = F.array_union(derived_events(F.col("outreach_status")),
                           F.coalesce(F.col(recorded), F.array().cast("array<string>")))
    counts = prospects.select(F.explode(events).alias("event")).groupBy("event").agg(
        F.count("*").alias("n"))
    names = prospects.sparkSession.createDataFrame(
        [(i, k, label) for i, (k, label) in enumerate(R.TIMELINE_EVENTS)],
        "position int, event string, label string")
    return names.join(counts, "event", "left").select(
        "position", "event", "label", F.coalesce("n", F.lit(0)).alias("institutions"))


def timeline_kpis(counts: DataFrame) -> DataFrame:
    def n(*events: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event").isin(*events), F.col("institutions"))),
                          F.lit(0))

    return counts.agg(n("FOLLOW_UP_1", "FOLLOW_UP_2").alias("follow_ups"),
                      n("EMAIL_SENT").alias("sent"), n("DRAFT_APPROVED").alias("approved"),
                      n("COLD_EMAIL_DRAFTED").alias("drafted"))
