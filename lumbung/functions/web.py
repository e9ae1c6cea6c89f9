"""URLs, e-mail addresses, fingerprints and institution ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumbung.functions.text import clean, fold_accents, squeeze
from lumbung.rules.evidence import PLAN_LOOKUP_URL, PORTAL_HOST, TENDER_LOOKUP_URL
from lumbung.rules.outreach import CONTACT_VERIFICATION_SOURCE

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def url_part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def has_web_provenance(c: Column) -> Column:
    """True for an http(s) address with a host."""
    text = squeeze(c)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return scheme.isin("http", "https") & (host != "")


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_email(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(EMAIL)


def https_url(c: Column) -> Column:
    """Canonical https address without fragment; null if it is not https or carries a login."""
    text = F.trim(c)
    rest = F.regexp_replace(text, "(?i)^https://", "")
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":443$", ""))
    tail = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*(.*)$", 1), "#.*$", "")
    path = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    valid = text.rlike("(?i)^https://") & (authority != "") & ~authority.contains("@") & \
        ~text.rlike(r"\s")
    return F.when(valid, F.concat(F.lit("https://"), host, path))


def contact_fingerprint(institution_id: Column, email: Column, url: Column,
                        source: Column | None = None) -> Column:
    """SHA-256 of the four parts joined by the unit separator; null without a valid address."""
    canonical = https_url(url)
    parts = F.concat_ws("\u001f", institution_id, normalize_email(email), canonical,
                        source if source is not None else F.lit(CONTACT_VERIFICATION_SOURCE))
    return F.when(canonical.isNotNull(), F.sha2(parts, 256))


def _utf16_units(c: Column) -> Column:
    """UTF-16 code units as integers."""
    return F.transform(
        F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1)),
        lambda h: F.conv(h, 16, 10).cast("long"))


def rolling_hash(c: Column) -> Column:
    """Base-36 text of the 32-bit hash h = h * 31 + unit."""
    h = F.aggregate(_utf16_units(c), F.lit(0).cast("long"),
                    lambda acc, u: (acc * 31 + u) % F.lit(4294967296))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def slug(c: Column, length: int) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(dashed, 1, length)


def institution_id(name: Column, accents: bool = True) -> Column:
    """Readable id: accent-free slug plus a hash of the exact name."""
    text = slug(fold_accents(F.lower(name)) if accents else name, 80)
    return F.concat(F.when(text == "", "institution").otherwise(text), F.lit("-"),
                    rolling_hash(name))


def plan_lookup_url(rup_id: Column, name: Column) -> Column:
    return F.concat(F.lit(PLAN_LOOKUP_URL), F.url_encode(F.when(rup_id != "", rup_id)
                                                         .otherwise(name)))


def tender_lookup_url(name: Column) -> Column:
    return F.concat(F.lit(TENDER_LOOKUP_URL), F.url_encode(name))


def portal_slug(url: Column, host: str = PORTAL_HOST) -> Column:
    """First path part of a portal address; null for another host or the national portal."""
    part = F.regexp_extract(F.coalesce(url_part(url, "PATH"), F.lit("")), "^/*([^/]+)", 1)
    return F.when((F.lower(url_part(url, "AUTHORITY")) == host)
                  & ~part.isin("", "nasional"), part)


def portal_base(url: Column, host: str = PORTAL_HOST) -> Column:
    return F.concat(F.lit(f"https://{host}/"), portal_slug(url, host))


def safe_text(c: Column) -> Column:
    return clean(c)
