"""Amounts, confidences and numeric similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumbung.functions.text import clean, squeeze
from lumbung.rules.contacts import CONFIDENCE_WORDS

MONEY = "decimal(20,2)"


def money(c: Column) -> Column:
    """Exact amount: sums of it do not depend on row order."""
    return c.cast(MONEY)


def _separators_to_number(digits: Column, first_group_only: bool) -> Column:
    """"604.650.000" / "1.234,56" style text to a double; null when it is not a number."""
    if first_group_only:
        return F.translate(digits, ",.", ".").try_cast("double")
    no_dots = F.replace(digits, F.lit("."), F.lit(""))
    commas = F.length(digits) - F.length(F.replace(digits, F.lit(","), F.lit("")))
    return F.when(commas > 1, F.replace(no_dots, F.lit(","), F.lit(""))).otherwise(
        F.replace(no_dots, F.lit(","), F.lit("."))
    ).try_cast("double")


def parse_budget(c: Column, m_is_billion: bool = False, legacy: bool = False) -> Column:
    """Amount text with Indonesian multiplier words.

    ``m_is_billion`` reads a bare "m" as miliar. ``legacy`` keeps only one separator group, so
    "604.650.000" reads as 604650; by default all thousands groups count.
    """
    text = F.trim(F.replace(F.replace(F.lower(clean(c)), F.lit("rp"), F.lit("")),
                            F.lit("rupiah"), F.lit("")))
    billion = r"\bmiliar\b|\bm\b|\bb\b" if m_is_billion else r"\bmiliar\b|\bb\b"
    factor = (
        F.when(text.rlike(r"\btriliun\b|\bt\b"), 1e12)
        .when(text.rlike(billion), 1e9)
        .when(text.rlike(r"\bjuta\b|\bjt\b"), 1e6)
        .when(text.rlike(r"\bribu\b|\bk\b"), 1e3)
        .otherwise(1.0)
    )
    pattern = r"\d+(?:[.,]\d+)?" if legacy else r"\d+(?:[.,]\d+)*"
    digits = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return _separators_to_number(digits, legacy) * factor


def parse_plain_budget(c: Column, legacy: bool = False) -> Column:
    """Amount text without words: separators decide."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9,.-]", "")
    has_comma, has_dot = text.contains(","), text.contains(".")
    many_dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) > 1
    dotless = F.replace(text, F.lit("."), F.lit(""))
    number = F.when(has_comma & has_dot, F.replace(dotless, F.lit(","), F.lit("."))).when(
        has_comma, F.replace(text, F.lit(","), F.lit(".")))
    if not legacy:
        number = number.when(many_dots, dotless)
    return F.nullif(number.otherwise(text), F.lit("")).try_cast("double")


def budget_similarity(a: Column, b: Column, zero_is_missing: bool = False) -> Column:
    score = F.greatest(
        F.lit(0.0), 1.0 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    missing = a.isNull() | b.isNull()
    if zero_is_missing:
        missing = missing | (a == 0) | (b == 0)
    return F.when(missing, 0.0).otherwise(score)


def confidence(c: Column, default: float = 0.0) -> Column:
    text = F.lower(squeeze(c))
    word = F.lit(default)
    for score, words in CONFIDENCE_WORDS.items():
        word = F.when(text.isin(words), score).otherwise(word)
    return F.when(text == "", default).otherwise(F.coalesce(text.try_cast("double"), word))


def rupiah(c: Column) -> Column:
    """Display form "Rp 1.234.567" (with a no-break space)."""
    return F.concat(F.lit("Rp\u00a0"), F.translate(F.format_number(c, 0), ",", "."))
