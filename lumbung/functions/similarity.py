"""Gestalt text similarity and the bounds that let most pairs be skipped.

The measure is the ratio of matched characters found by recursively taking the longest common
block. It is order-sensitive, so callers always pass (plan, evidence).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def ratio(left: str, right: str) -> float:
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    return SequenceMatcher(None, left, right).ratio()


@F.pandas_udf(DoubleType())
def gestalt(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two normalised texts; 0 when either is empty."""
    cache: dict[tuple[str, str], float] = {}
    out = []
    for a, b in zip(left, right):
        key = (a or "", b or "")
        if key not in cache:
            cache[key] = ratio(*key)
        out.append(cache[key])
    return pd.Series(out, dtype="float64")


def letter_counts(texts) -> np.ndarray:
    """How often each character of the normal form's alphabet occurs, one row per text.

    All other characters share a last column, which can only raise the bound made from it.
    """
    counts = np.zeros((len(texts), len(ALPHABET) + 1), dtype=np.int32)
    index = {ch: i for i, ch in enumerate(ALPHABET)}
    for row, text in enumerate(texts):
        for ch in text:
            counts[row, index.get(ch, len(ALPHABET))] += 1
    return counts


def upper_bound(counts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """No pair can score above twice its shared letters over its total length."""
    lengths, other_lengths = counts.sum(axis=1), other.sum(axis=1)
    shared = np.zeros((len(counts), len(other)), dtype=np.int32)
    for letter in range(counts.shape[1]):
        shared += np.minimum.outer(counts[:, letter], other[:, letter])
    total = lengths[:, None] + other_lengths[None, :]
    return np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 0.0)
