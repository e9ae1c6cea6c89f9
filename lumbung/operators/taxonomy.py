"""Demand taxonomy: which governed product families a title names, and in what sense."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.matching import any_pattern, has_any_phrase, has_phrase, let, padded
from lumbung.functions.text import word_text
from lumbung.rules import taxonomy as R


def _without_phrases(text: Column, phrases: list[str]) -> Column:
    """Blank out whole phrases one after the other, in list order."""
    for phrase in phrases:
        text = F.regexp_replace(
            text, rf"(?<![\p{{L}}\p{{N}}_]){re.escape(phrase)}(?![\p{{L}}\p{{N}}_])", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def printing_terms(title: Column) -> Column:
    """Sorted distinct consumable phrases; spans may overlap, so each pattern reads the title."""
    found = [F.regexp_extract_all(title, F.lit(p), F.lit(0)) for p in
             R.PRINTING_CONSUMABLE_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def names_printer_hardware(title: Column) -> Column:
    """"printer" outside every construction that only says what a consumable is for."""
    before = "".join(rf"(?<!\b{t} )" for t in R.PRINTER_REFERENTIAL_BEFORE)
    phrases = "".join(
        rf"(?!(?<=\b{left}printer){right}\b)" for left, right in R.PRINTER_REFERENTIAL_PHRASES)
    return title.rlike(rf"{before}\bprinter\b{phrases}")


def classify(df: DataFrame, title: str, procurement_type: str | None = None,
             unicode_safe: bool = True) -> DataFrame:
    """Add ``demand_families``, ``semantic_state``, ``matched_terms`` and ``rule_ids``.

    Narrow: no shuffle. The procurement type may settle the state, never a family.
    """
    kind = word_text(F.col(procurement_type), unicode_safe) if procurement_type else F.lit("")
    no_text = F.array().cast("array<string>")
    # One constant table of terms, scanned per title: a small plan whatever the vocabulary.
    part_family, part_term = R.CONSUMABLE_PHRASE_SUPPRESSES
    terms = F.expr("array(" + ", ".join(
        f"named_struct('position', {R.FAMILIES.index(f)}, 'family', '{f}', 'term', '{t}', "
        f"'padded', ' {t} ')" for f, listed in R.FAMILY_TERMS.items() for t in listed) + ")")

    def governed(title: Column) -> Column:
        # Masking only matters for the few titles that hold one of the unverified phrases.
        return F.when(has_any_phrase(padded(title), R.UNVERIFIED_TERMS),
                      padded(_without_phrases(title, R.UNVERIFIED_TERMS))
                      ).otherwise(padded(title))

    def term_hits(title: Column) -> Column:
        found = let(governed(title), lambda g: F.filter(terms, lambda t: g.contains(t["padded"])))
        return F.when(
            has_phrase(padded(title), R.CONSUMABLE_PHRASE),
            F.filter(found, lambda t: ~((t["family"] == part_family) & (t["term"] == part_term)))
        ).otherwise(found)

    def tagged(family: str, found: Column) -> Column:
        return F.transform(found, lambda t: F.struct(
            F.lit(R.FAMILIES.index(family)).alias("position"), F.lit(family).alias("family"),
            t.alias("term"), F.lit("").alias("padded")))

    def evidence(title: Column) -> Column:
        printing = title.rlike(r"printer|toner|refill|refil")
        consumables = F.when(printing, printing_terms(title)).otherwise(no_text)
        hardware = F.when(printing & names_printer_hardware(title), F.array(F.lit("printer"))
                          ).otherwise(no_text)
        return F.array_sort(F.concat(term_hits(title), tagged("PRINTING_CONSUMABLES", consumables),
                                     tagged("PRINTING_HARDWARE", hardware)))

    df = df.withColumn("_title", word_text(F.col(title), unicode_safe))
    df = df.withColumn("matched_terms", F.transform(
        let(F.col("_title"), evidence),
        lambda t: F.struct(t["family"].alias("family"), t["term"].alias("term"))))
    df = df.withColumn("demand_families", F.array_distinct(
        F.transform("matched_terms", lambda m: m["family"])))
    df = df.withColumns({"_padded": padded(F.col("_title")), "_kind": padded(kind)})
    is_part = has_phrase(F.col("_padded"), R.CONSUMABLE_PHRASE)
    names = F.col("demand_families")
    consumables = F.array_contains(names, "PRINTING_CONSUMABLES")

    state = None
    for label, terms in R.CONTEXT_TERMS.items():
        hit = has_any_phrase(F.col("_padded"), terms)
        state = F.when(hit, label) if state is None else state.when(hit, label)
    only_consumables = consumables & (F.size(names) == 1)
    state = (
        state.when(only_consumables | is_part, "PARTS_CONSUMABLE")
        .when(has_any_phrase(F.col("_padded"), R.PURCHASE_TERMS), "PURCHASE_EXPLICIT")
        .when(F.size("demand_families") > 0, "PRODUCT_ONLY_UNCONTRADICTED")
        .when(has_any_phrase(F.col("_kind"), R.PURCHASE_TERMS), "PURCHASE_EXPLICIT")
        .otherwise("NO_GOVERNED_DEMAND_MATCH")
    )
    df = df.withColumn("semantic_state", state)
    rules = F.concat(
        F.when(consumables, F.array(F.lit("PRINTING.CONSUMABLE_MASK"))).otherwise(no_text),
        F.when(F.array_contains(names, "PRINTING_HARDWARE"),
               F.array(F.lit("PRINTING.INDEPENDENT_HARDWARE"))).otherwise(no_text),
        F.transform(names, lambda f: F.concat(F.lit("FAMILY."), f, F.lit(".TERM"))),
        F.array(F.concat(F.lit("STATE."), F.col("semantic_state"))))
    return df.withColumn("rule_ids", rules).drop("_title", "_kind", "_padded")


def products_for(families: Column, family_products: dict[str, list[str]] | None = None) -> Column:
    """Ordered distinct product ids of a family list; unmapped families give none."""
    mapping = family_products or R.FAMILY_PRODUCTS
    table = F.create_map(*[x for family, ids in mapping.items()
                           for x in (F.lit(family), F.array(*map(F.lit, ids)))])
    per_family = F.transform(families, lambda f: F.coalesce(
        F.try_element_at(table, f), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(per_family))


def check_product_map(family_products: dict[str, list[str]], product_ids: set[str]) -> None:
    """Reject a map that names an unknown family or product."""
    unknown = set(family_products) - set(R.FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    missing = {p for ids in family_products.values() for p in ids} - product_ids
    if missing:
        raise ValueError(f"unknown products: {sorted(missing)}")


def relevant_products(df: DataFrame, title: str, procurement_type: str | None = None,
                      unicode_safe: bool = True) -> DataFrame:
    classified = classify(df, title, procurement_type, unicode_safe)
    return classified.withColumn("matched_product_ids", products_for(F.col("demand_families")))


def potential_matches(candidates: DataFrame, unicode_safe: bool = True) -> DataFrame:
    """Plans naming at least one catalogue product.

    Needs ``planned_procurement_id``, ``package_title`` and ``procurement_type``. Unique by plan:
    see ``duplicate_plans``; the sink orders by plan id.
    """
    named = sorted({t for terms in R.FAMILY_TERMS.values() for t in terms} | {"printer", "toner",
                   "refill", "refil"})
    # Cheap superset of the titles that can match; the classification sees only those.
    possible = word_text(F.col("package_title"), unicode_safe).rlike(any_pattern(named, re.escape))
    rows = relevant_products(candidates.where(possible), "package_title", "procurement_type",
                             unicode_safe)
    return rows.where(F.size("matched_product_ids") > 0).withColumn(
        "id_kldi", F.trim(F.coalesce(F.col("id_kldi").cast("string"), F.lit(""))))


def duplicate_plans(cohort: DataFrame) -> DataFrame:
    """Plan ids occurring more than once; a cohort is valid only if this is empty."""
    return cohort.groupBy("planned_procurement_id").agg(F.count("*").alias("occurrences")).where(
        "occurrences > 1")
