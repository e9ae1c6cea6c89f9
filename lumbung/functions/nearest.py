"""Best two offers by cost agreement, out of sorted offers (runs inside Spark tasks).

The agreement of two budgets falls on both sides of equality and is zero without a budget, so the
offers of a class that agree at least as well as any given one are neighbours in budget order. The
best ones are found by binary search; of equal ones the smallest ids by range minima. No pair of
plan and offer is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal budgets, falling to 0; 0 without one of them."""
    with np.errstate(invalid="ignore"):
        gap = np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1.0)
        return np.where(np.isnan(gap), 0.0, np.maximum(0.0, 1.0 - gap))


def rounded(value: np.ndarray) -> np.ndarray:
    """Millionths of the exact binary value between 0 and 1, halves to even."""
    low = np.floor(value * 1_000_000).astype(np.int64)
    exact = np.floor(value * float(1 << 62)).astype(np.int64)
    # exact * 2,000,000 against (2 * low + 1) * 2^62, both divided by 2^7, in two words of 32 bits
    high, rest = (exact >> 32) * 15_625, (exact & 0xFFFFFFFF) * 15_625
    high, rest = high + (rest >> 32), rest & 0xFFFFFFFF
    middle = (2 * low + 1) << 23
    up = (high > middle) | ((high == middle) & ((rest > 0) | (low % 2 == 1)))
    return low + up


class _Smallest:
    """Position of the smallest rank in any range [start, end), or -1."""

    def __init__(self, ranks: np.ndarray):
        self.at = np.append(np.argsort(ranks), -1)
        self.levels = [ranks]
        while 2 << (len(self.levels) - 1) <= len(ranks):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1)
        level = np.frexp(np.maximum(end - start, 1))[1] - 1
        for k, ranks in enumerate(self.levels):
            rows = np.flatnonzero((level == k) & (end > start))
            out[rows] = self.at[np.minimum(ranks[start[rows]], ranks[end[rows] - (1 << k)])]
        return out


def _first(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """Smallest position in [low, high) from which ``holds`` is true, else high."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        true = holds(open_, middle)
        high[open_] = np.where(true, middle, high[open_])
        low[open_] = np.where(true, low[open_], middle + 1)


def best_two(asked: pd.DataFrame, offers: pd.DataFrame, signal: float) -> pd.DataFrame:
    """Rows of ``asked`` with (candidate_id, e_budget) of their two best offers of the same class.

    Both sides have ``e_soft``, offers ``e_budget`` and ``candidate_id``. A row gives its
    ``p_budget`` and what precedes (``before``) and follows (``after``) the agreement in the sum of
    eight scores; the best have the budget signal, then the higher rounded mean, then the lower id.
    """
    ids = offers["candidate_id"].to_numpy(dtype=object)
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or ""))
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[by_id] = np.arange(len(ids))
    budgets, classes = offers["e_budget"].to_numpy(float), offers["e_soft"].to_numpy(np.int64)
    order = np.lexsort((budgets, classes))  # offers without a budget come last
    ids, budgets, classes = ids[order], budgets[order], classes[order]
    smallest = _Smallest(ranks[order])

    wanted, mine = asked["e_soft"].to_numpy(np.int64), asked["p_budget"].to_numpy(float)
    before = asked["before"].to_numpy(float)
    after = [asked[c].to_numpy(float) for c in asked.columns if c.startswith("after_")]
    start, end = np.searchsorted(classes, wanted), np.searchsorted(classes, wanted, "right")

    def key(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        cost = agreement(mine[rows], budgets[at])
        total = before[rows] + cost
        for part in after:
            total = total + part[rows]
        return rounded(total / 8) + np.where(cost >= signal, 2_000_000, 0)

    def inside(at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1)
        rows = np.flatnonzero((at >= start) & (at < end))
        out[rows] = key(rows, at[rows])
        return out

    def reach(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours around the own budget whose key is at least ``least``."""
        return (_first(start, middle, lambda r, at: key(r, at) >= least[r]),
                _first(middle, end, lambda r, at: key(r, at) < least[r]))

    middle = _first(start, end, lambda r, at: ~(budgets[at] < mine[r]))
    a, b = reach(np.maximum(inside(middle - 1), inside(middle)))
    one = smallest(a, b)
    lone = b - a == 1
    a, b = (np.where(lone, wider, own) for own, wider in zip((a, b), reach(np.maximum(
        inside(a - 1), inside(b)))))
    left, right = smallest(a, one), smallest(np.where(one < 0, b, one + 1), b)
    rank = np.append(ranks[order], len(ids))
    two = np.where(rank[left] < rank[right], left, right)
    at = np.concatenate([one, two])
    rows = np.concatenate([np.arange(len(asked))] * 2)[at >= 0]
    at = at[at >= 0]
    out = asked.iloc[rows].reset_index(drop=True)
    out["candidate_id"] = ids[at]
    out["e_budget"] = pd.Series(budgets[at]).astype(object).where(~np.isnan(budgets[at]), None)
    return out
