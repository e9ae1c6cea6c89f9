"""Contact joins: best-scored lookup and the fail-closed authority join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.ranking import one_per_group
from lumbung.functions.text import (clean_inner, key_pair, normalize_keep_nulls, normalize_place,
                                    squeeze)
from lumbung.functions.web import has_web_provenance
from lumbung.rules.contacts import HIERARCHY_LAYOUT_TYPE, LOOSE_SCORED_FIELDS

# ---- best-scored contact by prioritised keys -------------------------------------------------
LOOKUP_FIELDS = ["website", "email", "phone", "whatsapp", "pic_name", "pic_role", "address",
                 "source_url", "source_file"]


def _unit_keys(unit: Column, agency: Column) -> list[Column]:
    """Lookup keys, strongest first: unit with agency, both in one text, unit alone."""
    u, a = normalize_place(unit), normalize_place(agency)
    return [F.concat(u, F.lit("|"), a),
            normalize_place(F.concat(unit, F.lit(" "), agency)), u]


def contact_score(confidence: Column) -> Column:
    filled = [F.when(clean_inner(F.col(c)) != "", 1.0).otherwise(0.0) for c in
              LOOSE_SCORED_FIELDS]
    number = F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0))
    return sum(filled[1:], filled[0]) + number


def best_contact_index(contacts: DataFrame, position: str) -> DataFrame:
    """One contact per key: highest score, then the earlier row. Aggregated before the shuffle."""
    inst, agency = clean_inner(F.col("institution_name")), clean_inner(F.col("kldi"))
    pair, joined, alone = _unit_keys(inst, agency)
    keys = F.array_distinct(F.array(alone, joined, F.when(agency != "", pair).otherwise("")))
    rows = contacts.withColumn("_score", contact_score(F.col("confidence")))
    rows = rows.select(F.explode(keys).alias("key"), "_score", F.col(position).alias("_position"),
                       *[clean_inner(F.col(c)).alias(c) for c in LOOKUP_FIELDS])
    best = one_per_group(rows.where("key <> ''"), ["key"],
                         F.struct("_score", -F.col("_position")), largest=True)
    return best.drop("_score", "_position")


def with_best_contact(packages: DataFrame, index: DataFrame) -> DataFrame:
    """Add contact fields to packages.

    Units repeat over many packages, so the keys are resolved once per (unit, agency) and the
    wide package rows are joined once, not once per key.
    """
    unit, agency = clean_inner(F.col("satuanKerja")), clean_inner(F.col("kldi"))
    pairs = packages.select(unit.alias("_unit"), agency.alias("_agency")).distinct()
    wanted = pairs.select("_unit", "_agency", F.posexplode(F.array(*_unit_keys(
        F.col("_unit"), F.col("_agency")))).alias("_rank", "key"))
    found = wanted.join(index, "key")
    best = found.groupBy("_unit", "_agency").agg(F.min_by(
        F.struct(*LOOKUP_FIELDS), F.col("_rank")).alias("_c"))
    keyed = packages.withColumns({"_unit": unit, "_agency": agency})
    joined = keyed.join(best, ["_unit", "_agency"], "left")
    return joined.select(*packages.columns, *[
        F.coalesce(F.col(f"_c.{c}"), F.lit("")).alias(c) for c in LOOKUP_FIELDS])


# ---- fail-closed authority join --------------------------------------------------------------
KEY_NAMES = ["exact_display_name", "work_unit_parent_organization", "institution_name_region"]
CONTACT_OUT = ["source_file", "source_type", "institution_name", "institution_display_name",
               "parent_organization", "work_unit", "region", "contact_email", "official_website",
               "contact_phone", "contact_whatsapp", "contact_person", "contact_role",
               "contact_source_url", "contact_source_type", "contact_notes",
               "endpoint_organization", "endpoint_binding_explicit"]


def match_keys(contact: bool = True) -> Column:
    """The four natural keys of a canonical contact as a map."""
    return F.create_map(
        F.lit("institution_display_name"), normalize_keep_nulls(F.col("institution_display_name")),
        F.lit("work_unit_parent"), key_pair(F.col("work_unit"), F.col("parent_organization")),
        F.lit("institution_region"), key_pair(F.col("institution_name"), F.col("region")),
        F.lit("institution_name"), normalize_keep_nulls(F.col("institution_name")))


def authority_index(contacts: DataFrame) -> DataFrame:
    """Contacts by (key, scope, parent, region) with the number of distinct authorities.

    A target can only agree with candidates of its own parent and region, or with candidates
    silent on one of them. So three exact lookups answer "which authorities are consistent":

    * scope ``both``: candidates with exactly this parent and region (either may be blank),
    * scope ``parent``: all candidates of this parent, for targets without a region,
    * scope ``region``: all candidates of this region, for targets without a parent.

    Each scope is one row per lookup key, so the later join never pairs a popular name's targets
    with all its contacts.
    """
    rank = F.struct("completeness_score", "source_confidence", "source_priority",
                    -F.col("source_row"), F.xxhash64(*CONTACT_OUT))
    keyed = contacts.select(
        F.explode(F.array_distinct(F.map_values("match_keys"))).alias("key"),
        normalize_keep_nulls(F.col("parent_organization")).alias("parent"),
        normalize_keep_nulls(F.col("region")).alias("region_key"),
        rank.alias("rank"), F.struct(*CONTACT_OUT).alias("contact")
    ).where("key <> '' and (parent <> '' or region_key <> '')")
    both = keyed.groupBy("key", "parent", "region_key").agg(
        F.max_by("contact", "rank").alias("contact"), F.max("rank").alias("rank"))

    def widened(scope: str, kept: str, dropped: str) -> DataFrame:
        wide = both.where(F.col(kept) != "").groupBy("key", kept).agg(
            F.max_by("contact", "rank").alias("contact"), F.count("*").alias("authorities"))
        return wide.select("key", F.lit(scope).alias("scope"), *(
            [kept, F.lit("").alias(dropped)] if kept == "parent" else
            [F.lit("").alias(dropped), kept]), "authorities", "contact")

    exact = both.select("key", F.lit("both").alias("scope"), "parent", "region_key",
                        F.lit(1).cast("long").alias("authorities"), "contact")
    return exact.unionByName(widened("parent", "parent", "region_key")).unionByName(
        widened("region", "region_key", "parent"))


def resolve_contacts(targets: DataFrame, index: DataFrame, row_id: str) -> DataFrame:
    """The authoritative contact of each target, or none.

    Keys are tried in order; a key answers only if exactly one authority is consistent with the
    target's parent and region. Several authorities give no answer, whatever their scores.
    """
    region_hint = F.when(squeeze(F.col("province_or_region")) != "",
                         F.col("province_or_region")).otherwise(F.col("location_hint"))
    p = normalize_keep_nulls(F.col("parent_organization"))
    r = normalize_keep_nulls(region_hint)
    keys = F.array(normalize_keep_nulls(F.col("institution_display_name")),
                   key_pair(F.col("work_unit"), F.col("parent_organization")),
                   key_pair(F.col("institution_name"), region_hint))
    keyed = targets.select(F.col(row_id), p.alias("_p"), r.alias("_r"),
                           F.posexplode(keys).alias("key_rank", "key")).where("key <> ''")
    blank = F.lit("")

    def lookup(scope: str, parent: Column, region: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), parent.alias("parent"),
                        region.alias("region_key"))

    lookups = F.when((F.col("_p") != "") & (F.col("_r") != ""), F.array(
        lookup("both", F.col("_p"), F.col("_r")), lookup("both", F.col("_p"), blank),
        lookup("both", blank, F.col("_r")))).when(F.col("_p") != "", F.array(
            lookup("parent", F.col("_p"), blank))).when(F.col("_r") != "", F.array(
                lookup("region", blank, F.col("_r"))))
    asked = keyed.select(row_id, "key_rank", "key", F.explode(lookups).alias("l")).select(
        row_id, "key_rank", "key", "l.*")
    answers = asked.join(index, ["key", "scope", "parent", "region_key"])
    per_key = answers.groupBy(row_id, "key_rank", "key").agg(
        F.sum("authorities").alias("authorities"), F.any_value("contact").alias("contact"))
    best = per_key.where("authorities = 1").groupBy(row_id).agg(
        F.min_by(F.struct("key_rank", "key", "contact"), "key_rank").alias("m"))
    names = F.array(*map(F.lit, KEY_NAMES))
    return best.select(row_id, F.get(names, F.col("m.key_rank")).alias("contact_match_type"),
                       F.col("m.key").alias("contact_match_key"), F.col("m.contact").alias("c"))


def enrich_outreach(targets: DataFrame, index: DataFrame, row_id: str) -> DataFrame:
    """Targets with contact fields, status, scope and direct-outreach eligibility."""
    found = resolve_contacts(targets, index, row_id)
    replaced = {"contact_status", "contact_scope", "contact_match_type", "contact_match_key",
                *[c for c in CONTACT_OUT if c.startswith(("contact_", "official_"))]}
    kept = [c for c in targets.columns if c not in replaced]
    j = targets.join(found, row_id, "left")

    def c(name: str) -> Column:
        return F.coalesce(F.col(f"c.{name}"), F.lit(""))

    url = F.when(has_web_provenance(c("contact_source_url")), c("contact_source_url")
                 ).otherwise("")
    status = (F.when((c("contact_email") != "") & (url != ""), "CONTACT_FOUND")
              .when(c("contact_email") != "", "CONTACT_NEEDS_REVIEW")
              .otherwise("CONTACT_MISSING"))
    unit = squeeze(F.col("work_unit"))
    target = normalize_keep_nulls(F.when(unit != "", unit).otherwise(F.col("institution_name")))
    out = j.select(
        *kept, target.alias("_target"),
        F.coalesce("contact_match_type", F.lit("unmatched")).alias("contact_match_type"),
        F.coalesce("contact_match_key", F.lit("")).alias("contact_match_key"),
        c("source_file").alias("contact_match_source_file"),
        c("source_type").alias("contact_match_source_type"),
        c("institution_name").alias("contact_master_institution_name"),
        c("institution_display_name").alias("contact_master_display_name"),
        c("parent_organization").alias("contact_master_parent_organization"),
        c("work_unit").alias("contact_master_work_unit"),
        c("region").alias("contact_master_region"),
        *[c(n).alias(n) for n in ("contact_email", "official_website", "contact_phone",
                                  "contact_whatsapp", "contact_person", "contact_role")],
        url.alias("contact_source_url"), c("contact_source_type").alias("contact_source_type"),
        c("contact_notes").alias("contact_notes"), status.alias("contact_status"),
        normalize_keep_nulls(c("endpoint_organization")).alias("_endpoint"),
        F.coalesce(F.col("c.endpoint_binding_explicit"), F.lit(False)).alias("_bound"))
    bound = F.col("_bound") & (F.col("_endpoint") != "") & (F.col("_target") != "") & (
        F.col("contact_status") != "CONTACT_MISSING")
    scope = (
        F.when(~bound, "UNRESOLVED")
        .when((F.col("contact_match_source_type") == HIERARCHY_LAYOUT_TYPE)
              & (F.col("_endpoint") != F.col("_target")), "HIERARCHY_OFFICIAL")
        .when((F.col("contact_status") == "CONTACT_FOUND")
              & (F.col("_endpoint") == F.col("_target")), "DIRECT_INSTITUTION")
        .otherwise("UNRESOLVED"))
    out = out.withColumn("contact_scope", scope).drop("_target", "_endpoint", "_bound")
    return out.withColumn("direct_outreach_eligible", (
        F.col("contact_status") == "CONTACT_FOUND") & (
        F.col("contact_scope") == "DIRECT_INSTITUTION"))
