"""Term lists turned into column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_phrase(padded_text: Column, term: str) -> Column:
    """Whole-word phrase on single-spaced text; no regular expression needed."""
    return padded_text.contains(f" {term} ")


def has_any_phrase(padded_text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | has_phrase(padded_text, term)
    return hit


def word_form(text: Column) -> Column:
    """Padded lower-case text in which everything but letters and digits is one blank."""
    return padded(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")))


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(texts: list[str]) -> str:
    """Constant array of texts as one expression, however long the list."""
    return "array(" + ", ".join(map(sql_text, texts)) + ")" if texts else \
        "cast(array() as array<string>)"


def class_table(classes: dict[str, list[str]]) -> Column:
    """Constant table of classes: label, whole words (padded) and phrases."""
    rows = [f"named_struct('label', {sql_text(label)}, "
            f"'words', {sql_texts([f' {t} ' for t in terms if ' ' not in t])}, "
            f"'phrases', {sql_texts([t for t in terms if ' ' in t])})"
            for label, terms in classes.items()]
    return F.expr("array(" + ", ".join(rows) + ")")


def matching_classes(text: Column, classes: dict[str, list[str]]) -> Column:
    """Labels with a matching term: single words as whole words, phrases anywhere.

    ``text`` is lower-case. Containment tests on the text and its ``word_form`` replace patterns
    with look-around.
    """
    def labels(t: Column) -> Column:
        hit = F.filter(class_table(classes), lambda c: F.exists(
            c["words"], lambda w: t["words"].contains(w)) | F.exists(
            c["phrases"], lambda p: t["text"].contains(p)))
        return F.transform(hit, lambda c: c["label"])

    return let(F.struct(text.alias("text"), word_form(text).alias("words")), labels)


def any_pattern(terms: list[str], pattern=re.escape) -> str:
    return "|".join(pattern(t) for t in terms)


def matching_terms(terms: list[str], hit) -> Column:
    """Array of the terms for which ``hit(term)`` holds, in list order."""
    found = F.array(*[F.when(hit(t), F.lit(t)) for t in terms])
    return F.array_compact(found)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Keeps a long expression from being repeated when the optimizer moves a predicate built on it
    below the projection that named it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
