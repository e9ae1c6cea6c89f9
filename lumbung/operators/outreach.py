"""Institution rollup of relevant packages, target levels and the research batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.matching import any_pattern, let, matching_classes
from lumbung.functions.numbers import money
from lumbung.functions.ranking import first_k
from lumbung.functions.text import contains_any, display_name, region_of, split_list, squeeze
from lumbung.rules import outreach as R
from lumbung.session import cut_lineage


_VETOED = ""  # label of the veto terms inside the class table


def categories_of(name: Column, rules: dict[str, list[str]] | None = None,
                  veto: list[str] | None = None) -> Column:
    """Every category with a matching term, in rule order; none if a veto term matches."""
    rules, veto = rules or R.CATEGORY_TERMS, R.CATEGORY_VETO if veto is None else veto
    found = matching_classes(F.lower(squeeze(name)), {_VETOED: veto, **rules})
    return let(found, lambda f: F.when(F.array_contains(f, _VETOED), F.array().cast(
        "array<string>")).otherwise(f))


def target_level(name: Column) -> Column:
    """Administrative level from substring markers; short markers match inside words too."""
    text = F.lower(squeeze(name))
    rule = None
    for level, markers in R.TARGET_LEVELS.items():
        hit = contains_any(text, markers)
        rule = F.when(hit, level) if rule is None else rule.when(hit, level)
    return rule.otherwise(R.OTHER_LEVEL)


def relevant_packages(packages: DataFrame, rules=None, veto=None) -> DataFrame:
    """Packages with at least one product category, with their institution name."""
    unit, parent = squeeze(F.col("satuanKerja")), squeeze(F.col("kldi"))
    # Cheap superset first: a title without any of the terms cannot have a category.
    terms = sorted({t for listed in (rules or R.CATEGORY_TERMS).values() for t in listed})
    possible = packages.where(F.lower("paket").rlike(any_pattern(terms)))
    # A generator, because a filter on a plain column would move down and find them a second time.
    tagged = possible.withColumn("categories", F.explode(F.array(
        categories_of(F.col("paket"), rules, veto))))
    return tagged.where(F.size("categories") > 0).withColumn(
        "institution_name",
        F.when(unit != "", unit).when(parent != "", parent).otherwise("UNKNOWN_INSTITUTION"))


def institution_rollup(packages: DataFrame, months: list[str] | None = None, examples: int = 5,
                       rules=None, veto=None) -> DataFrame:
    """One row per institution: counts, budget, months, categories, examples, attributes.

    Attributes and examples come from the lowest package ids. All sums and sets are partially
    aggregated before the shuffle; examples are cut to ``examples`` rows per map task. Both read
    the relevant packages, which are therefore classified once and written out.
    """
    if months is not None:
        packages = packages.where(F.col("pemilihan").isin(months))
    rows = cut_lineage(relevant_packages(packages, rules, veto).select(
        "institution_name", "id", "pagu", "pemilihan", "satuanKerja", "kldi", "lokasi", "paket",
        "categories"))
    unit, parent = squeeze(F.col("satuanKerja")), squeeze(F.col("kldi"))
    first = F.struct(unit.alias("work_unit"), parent.alias("parent_organization"),
                     squeeze(F.col("lokasi")).alias("location_hint"))
    totals = rows.groupBy("institution_name").agg(
        F.count("*").alias("total_relevant_packages"),
        F.sum(F.coalesce(money(F.col("pagu")), money(F.lit(0)))).alias("total_pagu"),
        F.array_sort(F.collect_set(squeeze(F.col("pemilihan")))).alias("months"),
        F.min_by(first, F.col("id")).alias("first"),
        *[F.max(F.array_contains("categories", c)).alias(f"_{c}")
          for c in (rules or R.CATEGORY_TERMS)])
    labels = first_k(
        rows.select("institution_name", "id",
                    F.concat(squeeze(F.col("paket")), F.lit(" ["), F.col("id").cast("string"),
                             F.lit("]")).alias("label")),
        ["institution_name"], [F.col("id")], examples)
    labels = labels.groupBy("institution_name").agg(F.array_sort(F.collect_list(
        F.struct("_rank", "label"))).alias("labels"))
    names = sorted(rules or R.CATEGORY_TERMS)
    same = F.lower("first.work_unit") == F.lower("first.parent_organization")
    display = display_name(F.col("first.work_unit"), F.col("first.parent_organization"), same)
    joined = totals.join(labels, "institution_name")
    out = joined.select(
        "institution_name",
        F.when(display != "", display).otherwise(F.col("institution_name")).alias(
            "institution_display_name"),
        "first.parent_organization", "first.work_unit",
        region_of(F.col("first.location_hint")).alias("province_or_region"),
        "first.location_hint",
        "total_relevant_packages", F.col("total_pagu").cast("double").alias("total_pagu"),
        F.array_join("months", "; ").alias("months_found"),
        F.concat_ws("; ", *[F.when(F.col(f"_{c}"), c) for c in names]).alias(
            "relevant_categories"),
        F.array_join(F.transform("labels", lambda x: x["label"]), " | ").alias(
            "example_package_names"))
    level = target_level(F.col("institution_display_name"))
    return (
        out.withColumn("target_level", level)
        .withColumn("send_readiness", F.when(F.col("target_level") == R.OTHER_LEVEL,
                                             "NEEDS_REVIEW").otherwise("READY_FOR_CONTACT_SEARCH"))
        .withColumn("exclusion_reason", F.when(F.col("target_level") == R.OTHER_LEVEL,
                                               "REVIEW_REQUIRED").otherwise("NONE"))
        .withColumn("evidence_status", F.lit("SIRUP_PLANNING_ONLY"))
        .withColumn("spse_status", F.lit("SPSE_NOT_CHECKED_NATIONALLY"))
        .withColumn("contact_status", F.lit("CONTACT_MISSING"))
        .withColumn("outreach_status", F.lit("NOT_CONTACTED")))


def contact_template(rollup: DataFrame) -> DataFrame:
    """Rollup columns plus the empty contact fields a researcher fills in."""
    kept = ["institution_name", "institution_display_name", "parent_organization", "work_unit",
            "location_hint", "target_level", "total_relevant_packages", "total_pagu",
            "months_found", "relevant_categories"]
    blank = ["official_website", "contact_email", "contact_phone", "contact_person",
             "contact_role", "contact_source_url", "contact_source_type", "contact_notes"]
    return rollup.select(*kept, *[F.lit("").alias(c) for c in blank])


def level_rank(level: Column) -> Column:
    order = F.array(*map(F.lit, R.RESEARCH_LEVEL_ORDER))
    position = F.array_position(order, level)
    return F.when(position > 0, position - 1).otherwise(len(R.RESEARCH_LEVEL_ORDER))


def research_batch(rollup: DataFrame, size: int = 100) -> DataFrame:
    """The next institutions to research; REVIEW rows only fill up a short batch."""
    wanted = F.array(*map(F.lit, R.RESEARCH_PRIORITY_CATEGORIES))
    eligible = rollup.where(F.arrays_overlap(split_list(F.col("relevant_categories")), wanted))
    sure = F.count_if(~F.col("target_level").eqNullSafe("REVIEW"))
    enough = eligible.agg(sure >= size).scalar()
    chosen = eligible.where(~F.col("target_level").eqNullSafe("REVIEW") | ~enough)
    name = F.when(F.coalesce("institution_display_name", F.lit("")) != "",
                  F.col("institution_display_name")).otherwise(F.col("institution_name"))
    return chosen.withColumn("level_rank", level_rank(F.col("target_level"))).orderBy(
        "level_rank", F.desc("total_relevant_packages"), F.desc("total_pagu"), name,
        "institution_name").limit(size)
