"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumbung.rules.evidence import MONTH_NAMES, NAME_STOPWORDS, TRUE_WORDS

# Any white space, including the four control separators Java leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"
NULL_WORDS = ["nan", "none", "null"]
NULL_TEXT = r"(?iU)^[\s\x1c-\x1f]*(?:nan|none|null)[\s\x1c-\x1f]*$"


def squeeze(c: Column) -> Column:
    """Collapse white space and trim; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, " "))


def clean(c: Column) -> Column:
    """``squeeze`` that also empties the literals nan / none / null."""
    text = squeeze(c)
    return F.when(F.lower(text).isin(NULL_WORDS), F.lit("")).otherwise(text)


def clean_inner(c: Column) -> Column:
    """Trim only (inner white space kept) and empty the null literals."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), rf"^{SPACES}|{SPACES}$", "")
    return F.when(F.lower(text).isin(NULL_WORDS), F.lit("")).otherwise(text)


def _alnum(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize(c: Column) -> Column:
    """Lower-case letters and digits separated by single blanks.

    Equals squeezing first: white space is no letter or digit, so one pass collapses it all.
    """
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(NULL_TEXT), F.lit("")).otherwise(_alnum(text))


def normalize_keep_nulls(c: Column) -> Column:
    """As ``normalize``, but a cell reading "null" stays text."""
    return _alnum(F.coalesce(c.cast("string"), F.lit("")))


def normalize_place(c: Column) -> Column:
    """Normal form without the administrative words (kabupaten, kota, provinsi)."""
    text = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " ")
    bare = F.regexp_replace(F.trim(text), r"\b(kabupaten|kab|kota|provinsi|prov)\b", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def normalize_name(c: Column, stopwords: list[str] = NAME_STOPWORDS) -> Column:
    """Normal form without stop words; only single tokens are compared."""
    tokens = F.split(normalize(c), " ")
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_join(F.filter(tokens, lambda t: ~F.array_contains(stop, t)), " ")


def key_pair(left: Column, right: Column) -> Column:
    l, r = normalize_keep_nulls(left), normalize_keep_nulls(right)
    return F.when((l != "") & (r != ""), F.concat(l, F.lit(" || "), r)).otherwise("")


def display_name(unit: Column, parent: Column, same: Column | None = None) -> Column:
    """"unit — parent", or the one that is present; ``same`` tells when both mean one thing."""
    u, p = squeeze(unit), squeeze(parent)
    equal = same if same is not None else normalize_keep_nulls(unit) == normalize_keep_nulls(parent)
    return (
        F.when((u != "") & (p != "") & ~equal, F.concat(u, F.lit(" — "), p))
        .when(u != "", u)
        .otherwise(p)
    )


def best_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in cols], F.lit(""))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(clean(c), r"(20\d{2})", 1), F.lit("")).cast("int")


def location_parts(c: Column) -> tuple[Column, Column]:
    """(province, city) from "province, city"."""
    parts = F.filter(F.transform(F.split(clean_inner(c), ","), lambda x: F.trim(x)),
                     lambda x: x != "")
    return (F.coalesce(F.get(parts, F.lit(0)), F.lit("")),
            F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def region_of(c: Column) -> Column:
    """Text before the first comma."""
    return squeeze(F.get(F.split(squeeze(c), ",", 2), F.lit(0)))


def month_number(c: Column) -> Column:
    """Month from an English or Indonesian month name, else the first number 1-12."""
    text = F.lower(clean_inner(c))
    digits = F.nullif(F.regexp_extract(text, r"\b(1[0-2]|0?[1-9])\b", 1), F.lit(""))
    rule = None
    for name, number in MONTH_NAMES:
        hit = text.contains(name)
        rule = F.when(hit, number) if rule is None else rule.when(hit, number)
    return rule.otherwise(digits.cast("int"))


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMMM yyyy")


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_html(c: Column) -> Column:
    text = clean(c)
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>",
                    r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, " ")
    return clean(text)


def yes_like(c: Column) -> Column:
    return F.lower(clean(c)).isin(TRUE_WORDS)


def split_list(c: Column, separator: str = ";") -> Column:
    """Trimmed non-empty items of a joined list."""
    items = F.split(F.coalesce(c, F.lit("")), separator, -1) if separator != "|" else F.split(
        F.coalesce(c, F.lit("")), r"\|", -1)
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def organisation_name(c: Column) -> Column:
    """Agency name without presentation differences (portal prefix, Kab., letter case)."""
    text = squeeze(c)
    text = F.regexp_replace(text, r"(?i)^LPSE\s+", "")
    text = F.regexp_replace(text, r"(?i)^Kab\.?(?=\s)", "Kabupaten")
    text = F.regexp_replace(text, r"(?i)^Kota\.?(?=\s)", "Kota")
    return F.initcap(F.lower(text))


def geo_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def government_level(c: Column) -> Column:
    return F.regexp_replace(geo_key(c), r"^pemerintah\s+", "")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _nfkd_bare(values: pd.Series) -> pd.Series:
    def fold(v):
        if v is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKD", v)
                       if not "\u0300" <= ch <= "\u036f")

    return values.map(fold)


def _when_not_ascii(text: Column, udf) -> Column:
    """Send only non-ASCII values through Python; ASCII is its own normal form."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.coalesce(udf(F.when(~ascii_only, text)), text)


def nfkc(c: Column) -> Column:
    return _when_not_ascii(F.coalesce(c, F.lit("")), _nfkc)


def fold_accents(c: Column) -> Column:
    return _when_not_ascii(F.coalesce(c, F.lit("")), _nfkd_bare)


def word_text(c: Column, unicode_safe: bool = True) -> Column:
    """Lower-case words separated by single blanks, letters of any script kept.

    ``unicode_safe=False`` leaves out the compatibility normalisation, for text known to be
    plain; the plan then has no Python step.
    """
    text = nfkc(c) if unicode_safe else F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def contains_any(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def first_class(text: Column, classes: dict[str, list[str]], default: str | None) -> Column:
    """Label of the first class with a contained term."""
    rule = None
    for label, terms in classes.items():
        hit = contains_any(text, terms)
        rule = F.when(hit, label) if rule is None else rule.when(hit, label)
    return rule.otherwise(F.lit(default))


def method_family(c: Column) -> Column:
    from lumbung.rules import linkage as R

    text = normalize(c)
    return (
        F.when(contains_any(text, R.E_PURCHASING_TERMS), "E_PURCHASING")
        .when(contains_any(text, R.NON_TENDER_TERMS), "NON_TENDER")
        .when(contains_any(text, R.TENDER_TERMS), "TENDER")
        .otherwise(F.upper(text))
    )
