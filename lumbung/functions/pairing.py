"""Similar pairs between two blocks of distinct texts (runs inside Spark tasks)."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from lumbung.functions.similarity import letter_counts, upper_bound


def similar_pairs(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(left_text, right_text, score) of all pairs of distinct texts reaching the threshold.

    Shared letters bound the score and settle most pairs at once; each other pair is compared once,
    and what the comparison learns about a right text serves all its pairs.
    """
    a, b = (np.unique(x["text"].to_numpy(dtype=str)) for x in (left, right))
    close = upper_bound(letter_counts(a), letter_counts(b)) >= threshold
    out = []
    for j in np.flatnonzero(close.any(axis=0)):
        matcher = SequenceMatcher(None, "", str(b[j]))
        for i in np.flatnonzero(close[:, j]):
            matcher.set_seq1(str(a[i]))
            score = matcher.ratio()
            if score >= threshold:
                out.append((str(a[i]), str(b[j]), score))
    return pd.DataFrame(out, columns=["left_text", "right_text", "score"])
