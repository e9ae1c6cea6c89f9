"""Health-sector leads: predicate, classes, readiness, priority and their summary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.matching import any_pattern, let, matching_terms
from lumbung.functions.numbers import money
from lumbung.functions.text import clean_inner, contains_any, first_class, location_parts
from lumbung.rules import health as R


def lead_pattern(term: str) -> str:
    term = term.lower()
    return rf"\b{re.escape(term)}\b" if term in R.WHOLE_WORDS else re.escape(term)


def is_health_lead() -> Column:
    """Health context, no excluded subject, and equipment (or goods) in the title."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (
        "paket", "satuanKerja", "kldi", "lokasi", "jenisPengadaan")]))
    title = F.lower(F.coalesce("paket", F.lit("")))
    goods = F.col("jenisPengadaan") == R.GOODS_TYPE

    def holds(t: Column) -> Column:
        return (_names_any(t["text"], R.CONTEXT_KEYWORDS)
                & ~_names_any(t["title"], R.EXCLUDE_KEYWORDS)
                & (_names_any(t["title"], R.EQUIPMENT_KEYWORDS) | t["goods"]))

    return let(F.struct(text.alias("text"), title.alias("title"), goods.alias("goods")), holds)


def _names_any(text: Column, terms: list[str]) -> Column:
    """Some term is contained; the few short ones must be whole words."""
    lowered = [t.lower() for t in terms]
    whole = [t for t in lowered if t in R.WHOLE_WORDS]
    hit = contains_any(text, [t for t in lowered if t not in R.WHOLE_WORDS])
    return hit | text.rlike(any_pattern(whole, lead_pattern)) if whole else hit


def matched_keywords(text: Column, keywords: list[str] = R.KEYWORDS) -> Column:
    """Keywords found in a text, in case-insensitive order."""
    lowered = F.lower(text)
    ordered = sorted(set(keywords), key=str.lower)

    def hit(term: str) -> Column:
        if term.lower() in R.WHOLE_WORDS:
            return lowered.rlike(lead_pattern(term))
        return lowered.contains(term.lower())

    return matching_terms(ordered, hit)


def sector(text: Column) -> Column:
    return first_class(F.lower(text), R.SECTORS, R.SECTOR_DEFAULT)


def institution_type(text: Column) -> Column:
    return first_class(F.lower(text), R.INSTITUTION_TYPES, R.INSTITUTION_TYPE_DEFAULT)


def equipment_class(text: Column, matches: Column) -> Column:
    named = first_class(F.lower(text), R.EQUIPMENT_CLASSES, None)
    context = F.array(*map(F.lit, R.CONTEXT_KEYWORDS))
    in_context = F.arrays_overlap(F.transform(matches, F.lower), context)
    return F.coalesce(named, F.when(in_context, R.EQUIPMENT_CONTEXT_CLASS).otherwise(
        R.EQUIPMENT_DEFAULT))


def contact_readiness(email: Column, phone: Column, whatsapp: Column) -> Column:
    reachable = (phone != "") | (whatsapp != "")
    return (F.when((email != "") & reachable, R.READY_BOTH).when(email != "", R.READY_EMAIL)
            .when(reachable, R.READY_PHONE).otherwise(R.READY_NONE))


def priority(budget: Column, category: Column, readiness: Column) -> Column:
    has_contact = readiness != R.READY_NONE
    return (
        F.when((budget >= R.HIGH_BUDGET) & (has_contact | (category != R.EQUIPMENT_DEFAULT)),
               "High")
        .when(budget >= R.MID_BUDGET, F.when(has_contact, "High").otherwise("Medium"))
        .when((budget >= R.LOW_BUDGET) | has_contact, "Medium")
        .otherwise("Low"))


def data_confidence(matches: Column, readiness: Column) -> Column:
    strong = F.arrays_overlap(F.transform(matches, F.lower),
                              F.array(*[F.lit(k.lower()) for k in R.EQUIPMENT_KEYWORDS]))
    return F.when(strong, F.when(readiness != R.READY_NONE, "High").otherwise("Medium")
                  ).otherwise("Low")


def next_action(lead_priority: Column, readiness: Column) -> Column:
    return (F.when(readiness == R.READY_NONE, R.ACTION_RESEARCH)
            .when(lead_priority == "High", R.ACTION_INTRODUCE)
            .when(lead_priority == "Medium", R.ACTION_VALIDATE).otherwise(R.ACTION_MONITOR))


CONTACT_FIELDS = ["website", "email", "phone", "whatsapp", "pic_name", "pic_role", "address",
                  "source_url", "source_file"]


def build_leads(packages: DataFrame, source_year: int, reference_prefix: str = "sirup_raw",
                source_system: str = "SiRUP") -> DataFrame:
    """37-column lead rows. Contact fields are used when present (see ``best_contact``)."""
    for field in CONTACT_FIELDS:
        if field not in packages.columns:
            packages = packages.withColumn(field, F.lit(""))
    df = packages.select(
        "*",
        *[clean_inner(F.col(c)).alias(f"_{c}") for c in
          ("satuanKerja", "kldi", "paket", "lokasi", "jenisPengadaan", "source_file")])
    df = df.withColumn("_text", F.concat_ws(" ", "_paket", "_satuanKerja", "_kldi", "_lokasi",
                                            "_jenisPengadaan"))
    df = df.withColumn("_matches", matched_keywords(F.col("_text")))
    df = df.withColumn("_class", equipment_class(F.col("_text"), F.col("_matches")))
    contact = {c: clean_inner(F.col(c)) for c in CONTACT_FIELDS}
    df = df.withColumn("_ready", contact_readiness(contact["email"], contact["phone"],
                                                   contact["whatsapp"]))
    budget = F.coalesce(F.col("pagu").cast("double"), F.lit(0.0))
    df = df.withColumn("_priority", priority(budget, F.col("_class"), F.col("_ready")))
    province, city = location_parts(F.col("lokasi"))
    unit, parent, name = F.col("_satuanKerja"), F.col("_kldi"), F.col("_paket")
    rup = clean_inner(F.col("id"))
    note = F.concat(F.lit(R.LEAD_NOTE), F.when(F.col("_source_file") != "", F.concat(
        F.lit(" Contact enriched from local file: "),
        F.element_at(F.split("_source_file", "/"), -1), F.lit("."))).otherwise(""))
    columns = {
        "institution_name": unit,
        "region_or_daerah": F.when(parent != "", parent).otherwise(F.col("_lokasi")),
        "province": province, "city_or_regency": city,
        "sector": sector(F.col("_text")), "institution_type": institution_type(F.col("_text")),
        "address": contact["address"], "phone": contact["phone"],
        "whatsapp": contact["whatsapp"], "email": contact["email"],
        "website": contact["website"], "pic_name": contact["pic_name"],
        "pic_role": contact["pic_role"], "package_name": name,
        "needed_equipment": F.when(F.size("_matches") > 0, F.array_join(
            F.slice("_matches", 1, 8), ", ")).otherwise(F.col("_class")),
        "equipment_category": F.col("_class"), "procurement_description": name,
        "budget_value": budget, "budget_value_idr": budget,
        "procurement_method": clean_inner(F.col("metode")), "source_year": F.lit(source_year),
        "source_system": F.lit(source_system),
        "source_url_or_reference": F.concat(F.lit(f"{reference_prefix}.rup_id="), rup),
        "opportunity_priority": F.col("_priority"), "contact_readiness": F.col("_ready"),
        "data_confidence": data_confidence(F.col("_matches"), F.col("_ready")), "notes": note,
        "kldi": parent, "satker": unit, "work_unit": unit, "rup_id": rup,
        "package_id": clean_inner(F.col("id_referensi")), "procurement_status": F.lit(""),
        "schedule_or_period": clean_inner(F.col("pemilihan")), "fiscal_year": F.lit(source_year),
        "raw_keywords_matched": F.array_join("_matches", ", "),
        "recommended_next_action": next_action(F.col("_priority"), F.col("_ready")),
    }
    return df.select(*[c.alias(n) for n, c in columns.items()])


def lead_order() -> list[Column]:
    """Priority, then budget, then plan id so that ties are stable."""
    rank = F.when(F.col("opportunity_priority") == "High", 0).when(
        F.col("opportunity_priority") == "Medium", 1).when(
        F.col("opportunity_priority") == "Low", 2).otherwise(9)
    return [rank, F.desc("budget_value_idr"), F.col("rup_id").try_cast("long")]


def lead_totals(leads: DataFrame) -> DataFrame:
    def filled(c: str) -> Column:
        return F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"with_{c}")

    return leads.agg(
        F.count("*").alias("rows_exported"),
        F.count_distinct("institution_name").alias("unique_institutions"),
        F.coalesce(F.sum(money(F.col("budget_value_idr"))), F.lit(0)).cast("double").alias(
            "total_budget"),
        filled("email"), filled("phone"), filled("whatsapp"))


def lead_top_values(leads: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values; blanks take part in the ranking but are not shown."""
    counts = leads.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(
        F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(n).where("value <> ''")


def missing_contacts(leads: DataFrame) -> DataFrame:
    blank = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("email", "phone", "whatsapp")]
    return leads.where(blank[0] & blank[1] & blank[2]).select(
        "institution_name", "region_or_daerah", "province", "package_name",
        "equipment_category", "budget_value_idr", "opportunity_priority",
        "recommended_next_action", "source_url_or_reference")
