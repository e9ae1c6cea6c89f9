"""Intermediate tables grow with the rows, not with their pairs; results are those of all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from lumbung.functions.nearest import agreement, best_two, rounded
from lumbung.operators import linkage
from test_linkage import EVIDENCE, PLAN, decide


@pytest.fixture
def stored(monkeypatch):
    """Row counts of every table that the linkage writes."""
    counts, cut = [], linkage.cut_lineage

    def counting(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(linkage, "cut_lineage", counting)
    return counts


def budgets(count, seed):
    """Equal, close, opposite, tiny and missing budgets."""
    rng = random.Random(seed)
    return [rng.choice([None, 0.0, 0.5, -2e8, 1e9, 1e9 * (1 + rng.randrange(50) * 1e-7),
                        rng.uniform(-1e9, 1e9), rng.uniform(1e8, 2e9)]) for _ in range(count)]


def test_plans_of_one_text_make_no_pairs(spark, stored):
    rng = random.Random(4)
    texts = ("Pengadaan Server Data Center", "Kementerian Contoh", "Pusat Data")
    plans = [(f"p{i:03d}", *texts, rng.choice([2025, 2026, None]), b, "Tender", "Jakarta", "")
             for i, b in enumerate(budgets(200, 5))]
    evidence = [(f"e{i:03d}", rng.choice([texts[0], texts[0] + " Baru"]), *texts[1:],
                 rng.choice([2025, 2026]), b, rng.choice(["Tender", "Seleksi"]),
                 rng.choice(["Jakarta", "Bandung"]), "") for i, b in enumerate(budgets(300, 6))]
    rows = linkage.resolve_identity(
        spark.createDataFrame(plans, PLAN),
        spark.createDataFrame([(*e, "Selesai", "t", "r") for e in evidence], EVIDENCE)).collect()
    assert {r.plan_id: (r.identity_status, r.selected_candidate_id, r.remaining)
            for r in rows} == {p[0]: decide(p, evidence) for p in plans}
    assert max(stored) < 10_000  # 60,000 pairs survive


def test_best_two_of_a_class():
    rng = random.Random(7)
    mine, theirs = budgets(80, 8), budgets(120, 9)
    asked = pd.DataFrame({"row": range(80), "e_soft": [i % 3 for i in range(80)],
                          "p_budget": np.array(mine, float), "before": [
                              rng.choice([0.7, 2.0, 2.9123]) for _ in range(80)],
                          "after_x": [rng.choice([0.0, 0.31]) for _ in range(80)]})
    offers = pd.DataFrame({"e_soft": [i % 2 for i in range(120)], "e_budget": np.array(
        theirs, float), "candidate_id": [f"e{rng.randrange(10**6)}" for _ in range(120)]})
    got = best_two(asked, offers, 0.85).groupby("row")["candidate_id"].apply(set).to_dict()
    for i, (_, soft, p, before, after) in asked.iterrows():
        ranked = []
        for _, (other, e, name) in offers.iterrows():
            if other == soft:
                cost = 0.0 if np.isnan(p) or np.isnan(e) else max(
                    0.0, 1 - abs(p - e) / max(abs(p), abs(e), 1.0))
                ranked.append((cost < 0.85, -round((before + cost + after) / 8, 6), name))
        assert got.get(i, set()) == {name for *_, name in sorted(ranked)[:2]}


def test_rounding_and_agreement():
    values = np.array([0.2578125, 0.3546875, 0.0, 1.0, 0.5, 1 / 3, 0.1234565, 0.0078125])
    assert rounded(values).tolist() == [int(
        round(round(float(v), 6) * 1e6)) for v in values]
    assert agreement(np.array([2.0, 1.0, np.nan]), np.array([1.0, -1.0, 1.0])).tolist() == [
        0.5, 0.0, 0.0]


def test_equal_plans_are_ranked_once(spark):
    texts = ("Pengadaan Server Data Center", "Kementerian Contoh", "Pusat Data")
    kinds = [(*texts, 2025, 1e9, "Tender", "Jakarta", ""), (*texts, None, None, "", None, ""),
             ("Tinta", *texts[1:], 2025, 1e9, "Tender", "Jakarta", "")]
    plans = spark.createDataFrame([(f"p{i:03d}", *kinds[i % 3]) for i in range(90)], PLAN)
    evidence = spark.createDataFrame(
        [(f"e{i:02d}", *texts, 2025 + i % 2, b, "Tender", "Jakarta", "", "Selesai", "t", "r")
         for i, b in enumerate(budgets(40, 3))], EVIDENCE)
    members, ranked = linkage.audited_classes(plans, evidence)
    assert (members.count(), ranked.count()) == (90, 2 * 40)  # 60 * 40 pairs survive
    want = linkage.candidate_audit(plans.where("plan_id in ('p000', 'p001')"), evidence)
    want = {i: sorted(tuple(r)[1:] for r in want.where(f"plan_id = 'p00{i}'").collect())
            for i in (0, 1)}
    for tile in (1000, 7):
        got = linkage.every_plan(members, ranked, tile).collect()
        for i in range(90):
            mine = sorted(tuple(r)[1:] for r in got if r.plan_id == f"p{i:03d}")
            assert mine == want.get(i % 3, [])
