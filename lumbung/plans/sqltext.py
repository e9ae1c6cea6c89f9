"""Snippets for the oracle statements (plain SQL, no look-around patterns)."""

from __future__ import annotations

import re


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), '\\s+', ' ', 'g'))"


def normalize(expr: str) -> str:
    return f"trim(regexp_replace(lower({squeeze(expr)}), '[^a-z0-9]+', ' ', 'g'))"


def contains_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def has_any_phrase(text: str, terms: list[str]) -> str:
    """Whole-word phrases on a single-spaced text."""
    return contains_any(f"(' ' || {text} || ' ')", [f" {t} " for t in terms])


def bounded(text: str, terms: list[str]) -> str:
    """Single words bounded by non-alphanumerics, phrases anywhere."""
    parts = [f"contains({text}, {quote(t)})" if " " in t else
             f"regexp_matches({text}, {quote('(^|[^a-z0-9])' + re.escape(t) + '($|[^a-z0-9])')})"
             for t in terms]
    return "(" + " OR ".join(parts) + ")"


def whole_or_inside(text: str, terms: list[str], whole: list[str]) -> str:
    """Terms in ``whole`` as whole words, the others as substrings."""
    parts = [f"regexp_matches({text}, {quote(chr(92) + 'b' + t.lower() + chr(92) + 'b')})"
             if t.lower() in whole else f"contains({text}, {quote(t.lower())})" for t in terms]
    return "(" + " OR ".join(parts) + ")"


def first_class(text: str, classes: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"WHEN {contains_any(text, terms)} THEN {quote(label)}"
                     for label, terms in classes.items())
    return f"CASE {cases} ELSE {default} END"


def labels_where(conditions: dict[str, str]) -> str:
    """List of the labels whose condition holds, in the given order."""
    items = ", ".join(f"CASE WHEN {cond} THEN {quote(label)} END"
                      for label, cond in conditions.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"
