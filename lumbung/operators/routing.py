"""Agency-to-portal routing: exactly one consistent portal, or a reasoned refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.digests import digest_of
from lumbung.functions.text import geo_key, government_level, organisation_name, squeeze
from lumbung.rules import registry as R

ACTIVE, STALE = "ROUTING_ACTIVE", "ROUTING_STALE"
AMBIGUOUS, REJECTED = "ROUTING_AMBIGUOUS", "ROUTING_REJECTED"
DIGEST_FIELDS = ["status", "canonical_kldi_id", "source_kldi_name", "lpse_name",
                 "official_lpse_url", "acquisition_run_id", "receipt_chain_reference",
                 "receipt_chain_hash", "source_version", "registry_artifact_id",
                 "registry_artifact_hash", "registry_version", "normalization_rule_version",
                 "normalized_organization_name", "candidate_count", "province",
                 "government_level", "authority_scope"]


def binding_digest() -> Column:
    return digest_of(*[F.col(c) for c in DIGEST_FIELDS],
                     F.array_join("rejection_reasons", ";"))


def portal_index(registry: DataFrame) -> DataFrame:
    """One row per normalised portal name: how many portals bear it, and the only one if one."""
    urls = registry.groupBy("official_lpse_url").agg(F.count("*").alias("url_rows"))
    rows = registry.join(urls, "official_lpse_url", "left")
    fields = F.struct("lpse_name", "official_lpse_url", "registry_artifact_id",
                      "registry_artifact_hash", "registry_version", "province",
                      "government_level", "url_rows")
    return rows.groupBy(organisation_name(F.col("lpse_name")).alias("name_key")).agg(
        F.count("*").alias("candidate_count"), F.any_value(fields).alias("portal"))


def bind_routes(agencies: DataFrame, registry: DataFrame,
                rule_version: str = R.NAME_RULE_VERSION,
                contradictory: Column | None = None) -> DataFrame:
    """One binding per agency with status, reasons and digest.

    The registry is reduced to one row per name first, so agencies are joined to at most one row
    each, however many portals share a name.
    """
    index = portal_index(registry)
    a = agencies.withColumnsRenamed({"province": "_a_province", "government_level": "_a_level"})
    a = a.withColumn("name_key", organisation_name(F.col("source_kldi_name")))
    j = a.join(index, "name_key", "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0)))
    one = F.col("candidate_count") == 1
    portal = F.when(one, F.col("portal"))

    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    reasons = [F.when(squeeze(F.col(f)) == "", F.lit(f"MISSING_SIRUP_{f.upper()}"))
               for f in R.PLAN_ROUTING_FIELDS]
    if not rule_version.strip():
        reasons.append(F.lit("MISSING_NORMALIZATION_RULE_VERSION"))
    if contradictory is not None:
        reasons.append(F.when(contradictory, F.lit("CONTRADICTORY_EVIDENCE")))
    reasons += [
        F.when(F.col("candidate_count") > 1, F.lit("NORMALIZED_CANDIDATE_COUNT_NOT_ONE")),
        F.when(F.col("candidate_count") == 0, F.lit("NO_EXACT_NORMALIZED_CANDIDATE")),
        *[F.when(one & (squeeze(portal[f]) == ""), F.lit(f"MISSING_REGISTRY_{f.upper()}"))
          for f in R.REGISTRY_ROUTING_FIELDS],
        F.when(one & ~portal["url_rows"].eqNullSafe(F.lit(1)), F.lit("LPSE_URL_NOT_UNIQUE")),
        F.when(one & given(F.col("_a_province")) & given(portal["province"]) & (
            geo_key(F.col("_a_province")) != geo_key(portal["province"])),
            F.lit("PROVINCE_CONFLICT")),
        F.when(one & given(F.col("_a_level")) & given(portal["government_level"]) & (
            government_level(F.col("_a_level")) != government_level(portal["government_level"])),
            F.lit("GOVERNMENT_LEVEL_CONFLICT")),
    ]
    j = j.withColumn("rejection_reasons", F.array_sort(F.array_compact(F.array(*reasons))))
    status = (F.when(F.col("candidate_count") > 1, AMBIGUOUS)
              .when(one & (F.size("rejection_reasons") == 0), ACTIVE).otherwise(REJECTED))

    def chosen(name: str) -> Column:
        return F.when(one, squeeze(F.col(f"portal.{name}"))).otherwise("")

    out = j.select(
        status.alias("status"), *[squeeze(F.col(f)).alias(f) for f in R.PLAN_ROUTING_FIELDS],
        *[chosen(f).alias(f) for f in R.REGISTRY_ROUTING_FIELDS],
        F.lit(rule_version).alias("normalization_rule_version"),
        F.col("name_key").alias("normalized_organization_name"), "candidate_count",
        F.when(one, chosen("province")).otherwise(squeeze(F.col("_a_province"))).alias(
            "province"),
        F.when(one, chosen("government_level")).otherwise(squeeze(F.col("_a_level"))).alias(
            "government_level"),
        F.lit(R.ROUTING_SCOPE).alias("authority_scope"), "rejection_reasons")
    return out.withColumn("binding_digest", binding_digest())


def validate_routes(bindings: DataFrame, rule_version: str = R.NAME_RULE_VERSION,
                    source_version: str | None = None,
                    registry_version: str | None = None) -> DataFrame:
    """Turn active bindings whose inputs changed into stale ones."""
    changed = (F.col("binding_digest") != binding_digest()) | (
        F.col("authority_scope") != R.ROUTING_SCOPE) | (
        F.col("normalization_rule_version") != rule_version)
    if source_version is not None:
        changed = changed | (F.col("source_version") != source_version)
    if registry_version is not None:
        changed = changed | (F.col("registry_version") != registry_version)
    stale = changed & (F.col("status") == ACTIVE)
    out = bindings.withColumn("_stale", stale).withColumns({
        "status": F.when(F.col("_stale"), STALE).otherwise(F.col("status")),
        "rejection_reasons": F.when(F.col("_stale"), F.array(F.lit("AUTHORITY_INPUT_CHANGED"))
                                    ).otherwise(F.col("rejection_reasons"))})
    return out.withColumn("binding_digest", F.when(F.col("_stale"), binding_digest()).otherwise(
        F.col("binding_digest"))).drop("_stale")


def routes(bindings: DataFrame) -> DataFrame:
    """Only an active, unchanged binding exposes an address."""
    return validate_routes(bindings).where(F.col("status") == ACTIVE).select(
        "canonical_kldi_id", F.col("official_lpse_url").alias("route_url"))


def agency_names(plans: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Agencies with the one name their plans carry; several names make the agency ambiguous."""
    name = F.nullif(squeeze(F.col(name_column)), F.lit(""))
    return plans.groupBy(squeeze(F.col(id_column)).alias("canonical_kldi_id")).agg(
        F.count_distinct(name).alias("names"), F.min(name).alias("_name")).select(
        "canonical_kldi_id", "names",
        F.when(F.col("names") == 1, F.col("_name")).alias("source_kldi_name"))


def cohort_routes(cohort: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row per agency group of the cohort: its verdict, products and member count.

    Groups without an agency id, with several acquisitions or without a usable binding are
    rejected with a reason. Members stay rows (``cohort_members``): a group may be huge.
    """
    groups = cohort.groupBy("id_kldi").agg(
        F.count("*").alias("members"),
        F.count_distinct("acquisition_id").alias("acquisitions"),
        F.min(F.trim(F.coalesce("acquisition_id", F.lit("")))).alias("acquisition_id"))
    first = cohort.select("id_kldi", "planned_procurement_id", F.posexplode(
        "matched_product_ids").alias("pos", "product")).groupBy("id_kldi", "product").agg(
        F.min(F.struct("planned_procurement_id", "pos")).alias("seen"))
    products = first.groupBy("id_kldi").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("seen", "product"))), lambda x: x["product"]).alias("matched_product_ids"))
    j = groups.join(products, "id_kldi", "left").join(
        bindings.withColumnRenamed("canonical_kldi_id", "id_kldi").withColumnRenamed(
            "acquisition_run_id", "_run"), "id_kldi", "left")
    reason = (
        F.when(F.col("acquisitions") > 1, "inconsistent routing prerequisites")
        .when(F.trim("id_kldi") == "", "id_kldi is required")
        .when(F.col("acquisition_id") == "", "acquisition_id is required")
        .when(F.col("status").isNull(), "no routing binding"))
    active = reason.isNull() & (F.col("status") == ACTIVE)
    blank = F.lit("")
    return j.select(
        "id_kldi", "members", "matched_product_ids",
        F.when(reason.isNull(), F.col("status")).otherwise(REJECTED).alias("routing_status"),
        F.when(active, F.col("official_lpse_url")).otherwise(blank).alias("official_lpse_url"),
        F.when(reason.isNull(), F.col("binding_digest")).otherwise(blank).alias(
            "routing_binding_digest"),
        F.when(reason.isNotNull(), F.array(reason)).when(
            active, F.array().cast("array<string>")).otherwise(
            F.col("rejection_reasons")).alias("rejection_reasons"))


def cohort_members(cohort: DataFrame, group_routes: DataFrame) -> DataFrame:
    """Every member plan with the verdict of its agency group."""
    return cohort.select("id_kldi", "planned_procurement_id").join(
        group_routes.select("id_kldi", "routing_status", "official_lpse_url"), "id_kldi")
