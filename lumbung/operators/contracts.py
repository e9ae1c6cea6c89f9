"""Candidate contracts, the decision log, exact links and outreach eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.digests import digest_of
from lumbung.functions.numbers import money
from lumbung.rules import lineage as R

# ---- fixed values ---------------------------------------------------------------------------
REQUIRED = {
    "IDENTITY": ["planned_procurement_id", "source_rup_id", "id_satker", "id_kldi",
                 "institution_name", "kldi_name", "package_title"],
    "EXECUTION": ["execution_id", "source_package_id", "package_title"],
    "LINK": ["planned_procurement_id", "execution_id", "link_evidence_value"],
    "COMPATIBILITY": ["compatibility_id", "planned_procurement_id", "supplier_id",
                      "supplier_product_id", "compatibility_basis"],
    "CONTACT": ["contact_evidence_id", "buyer_identity_key", "contact_value", "source_locator",
                "observed_at"],
    "COMPLETENESS": ["acquisition_id", "observed_scope"],
}
SOURCE_KINDS = {
    "IDENTITY": ["CURRENT_SIRUP"], "EXECUTION": ["SPSE", "LPSE"],
    "COMPATIBILITY": ["SUPPLIER_CATALOG"], "CONTACT": ["CONTACT_SOURCE"],
}
SUBJECT = {"IDENTITY": "planned_procurement_id", "EXECUTION": "execution_id",
           "LINK": "planned_procurement_id", "COMPATIBILITY": "compatibility_id",
           "CONTACT": "contact_evidence_id", "COMPLETENESS": "acquisition_id"}
BINDINGS = {"IDENTITY": ["id_satker"], "EXECUTION": ["source_package_id"],
            "LINK": ["execution_id", "link_evidence_kind", "link_evidence_value"],
            "COMPATIBILITY": ["supplier_product_id"],
            "CONTACT": ["buyer_identity_key", "contact_value"],
            "COMPLETENESS": ["observed_scope"]}
MATURE = ["COMPLETE_COVERAGE_VERIFIED", "TRUSTED_ACQUISITION"]
PROVENANCE_FIELDS = ["source_kind", "source_locator", "observed_at", "acquisition_id",
                     "raw_receipt_id", "schema_version", "source_maturity"]
# ---- end of fixed values --------------------------------------------------------------------


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def provenance_violations(provenance: str = "provenance") -> Column:
    """Names of missing provenance parts; the time must be ISO-8601."""
    p = F.col(provenance)
    checks = [F.when(_blank(p[f]), F.lit(f"provenance.{f} is required"))
              for f in PROVENANCE_FIELDS]
    checks.append(F.when(~_blank(p["observed_at"]) & F.try_to_timestamp(
        p["observed_at"]).isNull(), F.lit("provenance.observed_at must be ISO-8601")))
    return F.array_compact(F.array(*checks))


def contract_violations(kind: str, provenance: str = "provenance") -> Column:
    """Broken requirements of a candidate row; an empty list means it may be decided."""
    p = F.col(provenance)
    checks = [F.when(_blank(F.col(f)), F.lit(f"{f} is required")) for f in REQUIRED[kind]]
    if kind in SOURCE_KINDS:
        checks.append(F.when(~F.coalesce(p["source_kind"].isin(SOURCE_KINDS[kind]),
                                         F.lit(False)), F.lit("source kind not accepted")))
    if kind == "LINK":
        checks.append(F.when(~F.coalesce(F.col("link_evidence_kind").isin(
            R.AUTHORITATIVE_LINKS), F.lit(False)), F.lit("link evidence is not authoritative")))
    if kind == "COMPLETENESS":
        checks.append(F.when(~F.coalesce(p["source_maturity"].isin(MATURE), F.lit(False)),
                             F.lit("source maturity below the completeness gate")))
    if kind == "COMPATIBILITY":
        checks.append(F.when(~F.col("compatibility_state").eqNullSafe(
            "COMPATIBILITY_CANDIDATE"), F.lit("only candidates can be decided")))
    return F.array_compact(F.array(*checks))


def decide(candidates: DataFrame, kind: str, timestamp: Column,
           evidence: Column, provenance: str = "provenance") -> DataFrame:
    """Decision-log rows for the sound candidates; ids follow from the content."""
    p = F.col(provenance)
    binding = F.to_json(F.struct(*BINDINGS[kind]), {"ignoreNullFields": "false"})
    sound = candidates.where(F.size(contract_violations(kind, provenance)) == 0)
    rows = sound.select(
        F.lit("CURRENT_PROCUREMENT_DECISION").alias("schema"), F.lit(1).alias("version"),
        F.lit(kind).alias("kind"), F.lit("VERIFIED").alias("result"),
        F.col(SUBJECT[kind]).alias("subject"),
        F.array(p["source_kind"], p["acquisition_id"], p["raw_receipt_id"]).alias("provenance"),
        evidence.alias("evidence_references"), timestamp.alias("timestamp"),
        binding.alias("bindings"))
    return rows.withColumn("decision_id", decision_content()).select(*R.DECISION_KEYS)


def decision_content() -> Column:
    """Digest of what a decision says, without its id and time."""
    return digest_of(F.col("schema"), F.col("version"), F.col("kind"), F.col("result"),
                     F.col("subject"), F.to_json("provenance"),
                     F.to_json("evidence_references"), F.col("bindings"))


def decision_log_violations(log: DataFrame) -> DataFrame:
    """(problem, key) rows: malformed records, repeated ids, contradictory decisions."""
    shape = (_blank(F.col("decision_id")) | _blank(F.col("kind")) | _blank(F.col("result"))
             | _blank(F.col("subject")) | _blank(F.col("timestamp"))
             | ~F.coalesce(F.size("provenance") == 3, F.lit(False))
             | ~F.coalesce(F.size("evidence_references") > 0, F.lit(False))
             | F.coalesce(F.exists("evidence_references", lambda x: F.trim(x) == ""),
                          F.lit(True)) | F.col("bindings").isNull())
    malformed = log.where(shape).select(F.lit("malformed").alias("problem"),
                                        F.col("decision_id").alias("key"))
    repeated = log.groupBy("decision_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate decision id").alias("problem"), F.col("decision_id").alias("key"))
    said = log.groupBy("kind", "subject").agg(
        F.min(decision_content()).alias("a"), F.max(decision_content()).alias("b"))
    against = said.where("a <> b").select(
        F.lit("contradictory decisions").alias("problem"),
        F.concat_ws("/", "kind", "subject").alias("key"))
    return malformed.unionByName(repeated).unionByName(against)


def appendable(log: DataFrame, new: DataFrame) -> DataFrame:
    """New records whose id is unused and whose content agrees with earlier decisions."""
    fresh = new.join(log.select("decision_id"), "decision_id", "left_anti")
    said = log.withColumn("_c", decision_content()).groupBy("kind", "subject").agg(
        F.min("_c").alias("_said"))
    j = fresh.withColumn("_c", decision_content()).join(said, ["kind", "subject"], "left")
    return j.where(F.col("_said").isNull() | (F.col("_said") == F.col("_c"))).select(*new.columns)


def contains_exact(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected records found exactly once and unchanged."""
    own = log.groupBy("decision_id").agg(
        F.count("*").alias("n"), F.min(decision_content()).alias("c"),
        F.min("timestamp").alias("t")).where("n = 1")
    e = expected.withColumn("_c", decision_content())
    return e.join(own, (e["decision_id"] == own["decision_id"]) & (e["_c"] == own["c"])
                  & (e["timestamp"] == own["t"]), "left_semi").drop("_c")


def verified_by(candidates: DataFrame, log: DataFrame, kind: str,
                provenance: str = "provenance") -> DataFrame:
    """Add ``verified``: a decision of this kind binds exactly this candidate."""
    p = F.col(provenance)
    binding = F.to_json(F.struct(*BINDINGS[kind]), {"ignoreNullFields": "false"})
    proof = F.to_json(F.array(p["source_kind"], p["acquisition_id"], p["raw_receipt_id"]))
    c = candidates.withColumns({"_subject": F.col(SUBJECT[kind]), "_bind": binding,
                                "_proof": proof})
    have = log.where((F.col("kind") == kind) & (F.col("result") == "VERIFIED")).select(
        F.col("subject").alias("_subject"), F.col("bindings").alias("_bind"),
        F.to_json("provenance").alias("_proof")).distinct().withColumn("_yes", F.lit(True))
    return c.join(have, ["_subject", "_bind", "_proof"], "left").withColumn(
        "verified", F.coalesce("_yes", F.lit(False))).drop("_subject", "_bind", "_proof", "_yes")


# ---- links -----------------------------------------------------------------------------------
def exact_links(executions: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan-execution links through exact published plan codes only.

    ``executions`` has execution_id and kode_rup_rows (array of structs with kode_rup).
    """
    codes = executions.select("execution_id", F.explode("kode_rup_rows").alias("r")).select(
        "execution_id", F.trim("r.kode_rup").alias("link_evidence_value")).where(
        "link_evidence_value <> ''").distinct()
    keys = plans.select("planned_procurement_id",
                        F.col("source_rup_id").alias("link_evidence_value"))
    return codes.join(keys, "link_evidence_value").select(
        "planned_procurement_id", "execution_id",
        F.lit("EXACT_KODE_RUP_FROM_EXECUTION_DETAIL").alias("link_evidence_kind"),
        "link_evidence_value")


def authoritative_links(links: DataFrame) -> DataFrame:
    """Links whose evidence may verify a realisation; titles and reviews never do."""
    return links.where(F.col("link_evidence_kind").isin(R.AUTHORITATIVE_LINKS))


# ---- eligibility -----------------------------------------------------------------------------
def outreach_eligibility(plans: DataFrame, compatibilities: DataFrame,
                         contacts: DataFrame) -> DataFrame:
    """Per (plan, compatibility, contact) request: reasons for each unverified part.

    Inputs carry ``verified``. Everything verified allows review only, never sending.
    """
    c = compatibilities.select("planned_procurement_id", "compatibility_id",
                               F.col("verified").alias("_product"))
    b = contacts.select("buyer_identity_key", "contact_evidence_id",
                        F.col("verified").alias("_contact"))
    j = plans.withColumnRenamed("verified", "_plan").join(
        c, "planned_procurement_id", "left").join(b, "buyer_identity_key", "left")

    def missing(flag: str, reason: str) -> Column:
        return F.when(~F.coalesce(F.col(flag), F.lit(False)), F.lit(reason))

    reasons = F.array_compact(F.array(
        missing("_plan", R.REASON_PLAN), missing("_product", R.REASON_PRODUCT),
        missing("_contact", R.REASON_CONTACT)))
    out = j.withColumn("_reasons", reasons)
    ready = F.size("_reasons") == 0
    return out.select(
        "planned_procurement_id", "buyer_identity_key", "compatibility_id",
        "contact_evidence_id",
        F.when(ready, "ELIGIBLE_FOR_REVIEW").otherwise("NOT_ELIGIBLE").alias(
            "eligibility_state"),
        F.when(ready, F.array(F.lit(R.REASON_APPROVAL))).otherwise(F.col("_reasons")).alias(
            "reason_codes"))


# ---- execution rows and identities -----------------------------------------------------------
def execution_candidates(details: DataFrame) -> DataFrame:
    """Execution rows as candidates plus ``violations``; mixed value fields give no value."""
    year = F.col("fiscal_year").cast("string")
    needed = [F.when(_blank(F.col(f)), F.lit(f"{f} is required"))
              for f in ("package_code", "package_name", "stage_or_status")]
    needed.append(F.when(~F.coalesce(year.rlike("^[0-9]+$"), F.lit(False)),
                         F.lit("fiscal_year is required")))

    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return details.select(
        F.concat(F.lit("lpse:"), "package_code").alias("execution_id"),
        F.col("package_code").alias("source_package_id"), F.lit("LPSE").alias("source_kind"),
        F.lit(None).cast("string").alias("id_satker"),
        F.lit(None).cast("string").alias("id_kldi"),
        optional("institution_name").alias("institution_name"),
        F.col("package_name").alias("package_title"),
        F.col("stage_or_status").alias("execution_stage"),
        optional("method").alias("procurement_method"),
        money(F.lit(None)).alias("contract_value"), year.try_cast("int").alias("source_year"),
        F.array_compact(F.array(*needed)).alias("violations"))


def accepted_identities(decisions: DataFrame, plans: DataFrame) -> DataFrame:
    """Institution identities: confirmed matches that carry both institution and unit signals."""
    sure = decisions.where(
        (F.col("identity_status") == "CONFIRMED_MATCH")
        & F.array_contains("match_signals", "INSTITUTION")
        & F.array_contains("match_signals", "SATKER")
        & F.col("selected_candidate_id").isNotNull())
    return sure.join(plans, "plan_id").select(
        F.concat(F.lit("sirup-institution-"), digest_of(
            F.col("id_kldi"), F.col("id_satker"))).alias("buyer_identity_key"),
        "id_satker", "id_kldi", "institution_name", "plan_id")


def append_reviews(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human verdicts bound to the machine decision's digest; decisions stay untouched.

    ``decisions``: decision_id, decision_digest, review_record_id, review_digest.
    ``reviews``: decision_id, human_decision, reviewer_id, reviewed_at.
    """
    valid = reviews.where(F.col("human_decision").isin("CONFIRM_MATCH", "REJECT_MATCH"))
    j = valid.join(decisions.where(F.col("review_record_id").isNotNull()), "decision_id")
    out = j.select(
        "human_decision", "reviewer_id", "reviewed_at",
        F.col("decision_id").alias("machine_decision_id"),
        F.col("decision_digest").alias("machine_evidence_digest"),
        F.col("review_record_id").alias("manual_review_record_id"),
        F.col("review_digest").alias("manual_review_record_digest"))
    return out.withColumn("review_decision_id", F.concat(F.lit("human-review-"), F.substring(
        digest_of(*[F.col(c) for c in out.columns]), 1, 24)))
