"""Linkage decisions against a plain all-pairs restatement of the rules on a small fixture."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lumbung.operators import contracts, linkage

PLAN = "plan_id string, package_name string, institution string, satker string, year int, " \
       "budget double, procurement_method string, location string, category string"
EVIDENCE = PLAN.replace("plan_id", "candidate_id") + ", source_status string, " \
    "collected_at string, source_record_id string"

NAMES = ["Pengadaan Server Data Center", "Pengadaan Server Data Centre Baru",
         "Pembangunan Jalan KSPEAN Wanam", "Pengadaan Barrier Gate dan Alat Kamera", "Tinta",
         "Pengadaan Laptop Dinas", "Belanja Laptop untuk Dinas", "", "---"]
PLACES = ["Kementerian Contoh", "Kementerian Contoh Lain", "Pemerintah Kabupaten Lain",
          "Pemerintah Kota Lain", "Badan Pusat", "", "---", "Kementerian Conto"]
UNITS = ["Pusat Data", "Pusat Data dan Informasi", "Dinas Pekerjaan Umum", "", "Dinas Pekerjaan"]
WAYS = ["Tender", "E-Purchasing", "Pengadaan Langsung", "Swakelola", "", "Penunjukan Langsung"]


def rows(count, prefix, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        out.append((f"{prefix}{i:03d}", rng.choice(NAMES), rng.choice(PLACES), rng.choice(UNITS),
                    rng.choice([2025, 2026, None]), rng.choice([1e9, 9.8e8, 5e8, None]),
                    rng.choice(WAYS), rng.choice(["Jakarta", "Jakarta Pusat", "Bandung", ""]),
                    rng.choice(["Barang", "Jasa", ""])))
    return out


# ---- plain restatement -----------------------------------------------------------------------
def norm(s):
    return " ".join(re.sub("[^a-z0-9]+", " ", (s or "").lower()).split())


def sim(a, b):
    a, b = norm(a), norm(b)
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def family(s):
    t = norm(s)
    if "e purchasing" in t or "epurchasing" in t or "katalog" in t:
        return "EP"
    if "non tender" in t or "pengadaan langsung" in t:
        return "NT"
    return "T" if "tender" in t or "seleksi" in t else t.upper()


def judge(p, e):
    money = 0.0 if p[5] is None or e[5] is None else max(
        0.0, 1 - abs(p[5] - e[5]) / max(abs(p[5]), abs(e[5]), 1.0))
    s = {k: sim(p[i], e[i]) for k, i in (("N", 1), ("I", 2), ("S", 3), ("L", 7), ("C", 8))}
    signals = {k for k in "NIS" if s[k] >= .8}
    if p[4] is not None and p[4] == e[4]:
        signals.add("Y")
    if p[5] is not None and e[5] is not None and money >= .85:
        signals.add("B")
    if p[6] and e[6] and family(p[6]) == family(e[6]):
        signals.add("M")
    signals |= {k for k, i in (("L", 7), ("C", 8)) if p[i] and e[i] and s[k] >= .8}
    hard = {k for k, i, t in (("I", 2, .65), ("S", 3, .65), ("N", 1, .45))
            if p[i] and e[i] and s[k] < t}
    a, b = family(p[6]), family(e[6])
    if a and b and a != b and ({a, b} == {"T", "NT"} or "EP" in (a, b)):
        hard.add("M")
    mean = round(sum([s["N"], s["I"], s["S"], money, s["L"], s["C"], 0.0, 0.0]) / 8, 6)
    return signals, hard, mean


def decide(p, evidence):
    judged = [(e[0], *judge(p, e)) for e in evidence]
    left = sorted((-len(g & set("NIS")), -len(g), -m, c, g) for c, g, h, m in judged if not h)
    if not left:
        kinds = set().union(*[h for _, _, h, _ in judged])
        labels = [n for k, n in (("I", "INSTITUTION"), ("S", "SATKER"), ("N", "PACKAGE"),
                                 ("M", "PROCUREMENT_METHOD")) if k in kinds]
        return (f"REJECTED_{labels[0] if len(labels) == 1 else 'IDENTITY'}_CONFLICT", None, 0)
    top, g = left[0], left[0][4]
    if len(left) > 1 and left[1][:3] == top[:3]:
        status = "NEEDS_MANUAL_REVIEW"
    elif "N" in g and g & {"I", "S"} and len(g) >= 3:
        status = "CONFIRMED_MATCH"
    elif len(g) >= 2 and g & set("NIS"):
        status = "PROBABLE_MATCH"
    else:
        status = "NEEDS_MANUAL_REVIEW" if g else "NO_MATCH"
    return status, None if status == "NO_MATCH" else top[3], len(left)


@pytest.fixture(scope="module")
def sides(spark):
    plans, evidence = rows(60, "p", 1), rows(45, "e", 2)
    ev = [(*e, "Tender berjalan", "2026-07-01", e[0]) for e in evidence]
    return (plans, evidence, spark.createDataFrame(plans, PLAN),
            spark.createDataFrame(ev, EVIDENCE))


@pytest.mark.parametrize("tile", [2000, 7])
def test_same_as_all_pairs(sides, tile):
    plans, evidence, p, e = sides
    got = {r.plan_id: (r.identity_status, r.selected_candidate_id, r.remaining)
           for r in linkage.resolve_identity(p, e, tile=tile).collect()}
    assert got == {x[0]: decide(x, evidence) for x in plans}


def test_surviving_candidates_agree(sides):
    plans, evidence, p, e = sides
    want = {(x[0], y[0]) for x in plans for y in evidence if not judge(x, y)[1]}
    rows_ = linkage.surviving_candidates(p, e, tile=9).collect()
    assert {(r.plan_id, r.candidate_id) for r in rows_} == want
    audit = linkage.candidate_audit(p, e).collect()
    assert {(r.plan_id, r.candidate_id) for r in audit} == want
    details = {c.type: c.detail for r in audit for c in r.conflicts}
    assert details["YEAR_CONFLICT"] in ("2025 != 2026", "2026 != 2025")


def test_rejected_counts(sides):
    plans, evidence, p, e = sides
    got = {r.plan_id: tuple(r)[1:] for r in linkage.rejected_counts(p, e, tile=9).collect()}
    for x in plans:
        met = [judge(x, y)[1] for y in evidence]
        assert got[x[0]] == tuple(sum(k in h for h in met) for k in "ISNM")


def test_rejection_labels_need_one_kind(spark):
    base = ("p", "Pengadaan Server Data Center", "Kementerian Contoh", "Pusat Data", 2026, 1e9,
            "Tender", "Jakarta", "")
    cases = {
        "REJECTED_PACKAGE_CONFLICT": {1: "Barrier Gate dan Alat Kamera Zzz Qq"},
        "REJECTED_INSTITUTION_CONFLICT": {2: "Pemerintah Kabupaten Lain"},
        "REJECTED_SATKER_CONFLICT": {3: "Dinas Pekerjaan Umum"},
        "REJECTED_PROCUREMENT_METHOD_CONFLICT": {6: "E-Purchasing"},
        "REJECTED_IDENTITY_CONFLICT": {3: "Dinas Pekerjaan Umum", 6: "E-Purchasing"},
        "CONFIRMED_MATCH": {4: 2025},
    }
    plans = spark.createDataFrame([base], PLAN)
    for status, change in cases.items():
        other = ["e1", *base[1:]]
        for i, v in change.items():
            other[i] = v
        e = spark.createDataFrame([(*other, "Selesai", "t", "r")], EVIDENCE)
        row = linkage.resolve_identity(plans, e).first()
        assert row.identity_status == status, status


def test_ties_go_to_review_and_order_does_not_matter(spark):
    base = ("p", "Pengadaan Server", "Kementerian Contoh", "Pusat Data", 2026, 1e9, "Tender",
            "Jakarta", "")
    plans = spark.createDataFrame([base], PLAN)
    twins = [("e-b", *base[1:], "Tender", "t1", "r"), ("e-a", *base[1:], "Tender", "t1", "r")]
    out = []
    for order in (twins, twins[::-1]):
        e = spark.createDataFrame(order, EVIDENCE)
        row = linkage.audit_records(linkage.resolve_identity(plans, e), e, "v1").first()
        assert row.identity_status == "NEEDS_MANUAL_REVIEW"
        assert [b.candidate_id for b in row.best] == ["e-a", "e-b"]
        assert row.review_record_id.startswith("review-")
        out.append((row.decision_id, row.review_record_id))
    assert out[0] == out[1]


def test_no_evidence_is_planning_only(spark):
    plans = spark.createDataFrame([rows(1, "p", 3)[0]], PLAN)
    e = spark.createDataFrame([], EVIDENCE)
    row = linkage.with_status(linkage.resolve_identity(plans, e), e).first()
    assert (row.identity_status, row.normalized_status) == ("NO_MATCH", "SIRUP_PLANNING_ONLY")


def test_status_is_the_newest_of_the_accepted_candidate(spark):
    base = ("p", "Pengadaan Server", "Kementerian Contoh", "Pusat Data", 2026, 1e9, "Tender",
            "Jakarta", "")
    plans = spark.createDataFrame([base], PLAN)
    e = spark.createDataFrame([
        ("e1", *base[1:], "Tender", "2026-06-01", "old"),
        ("e1", *base[1:], "Pemenang berkontrak", "2026-07-01", "latest"),
        ("e2", "Pembangunan Jalan Desa", "Pemerintah Kabupaten Lain", "Dinas Pekerjaan Umum",
         2026, 1e9, "Tender", "Jakarta", "", "Selesai", "2026-09-01", "x")], EVIDENCE)
    decided = linkage.resolve_identity(plans, e)
    row = linkage.with_status(decided, e).first()
    assert (row.normalized_status, row.observed_at) == ("CONTRACTED", "2026-07-01")
    ids = plans.select("plan_id", F.lit("9").alias("id_satker"), F.lit("K").alias("id_kldi"),
                       F.col("satker").alias("institution_name"))
    assert contracts.accepted_identities(decided, ids).count() == 1


def test_reviews_are_appended(spark):
    base = ("p", "Pengadaan Server", "Kementerian Contoh", "Pusat Data", 2026, 1e9, "Tender",
            "Jakarta", "")
    plans = spark.createDataFrame([base], PLAN)
    e = spark.createDataFrame([(c, *base[1:], "Tender", "t", "r") for c in ("a", "b")], EVIDENCE)
    audited = linkage.audit_records(linkage.resolve_identity(plans, e), e, "v1")
    key = audited.first().decision_id
    reviews = spark.createDataFrame([(key, "CONFIRM_MATCH", "me", "now"),
                                     (key, "MAYBE", "me", "now")],
                                    "decision_id string, human_decision string, "
                                    "reviewer_id string, reviewed_at string")
    out = contracts.append_reviews(audited, reviews).collect()
    assert [r.human_decision for r in out] == ["CONFIRM_MATCH"]
    assert out[0].review_decision_id.startswith("human-review-")


def test_similar_part_texts(spark, tmp_path):
    """The registered query over names with other characters against an all-pairs restatement."""
    rng = random.Random(8)
    words = ["caf\u00e9", "ring", "rings", "bolt-7", "bolt 8", "large", "Larger"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
             for _ in range(150)] + ["", None]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string"
                          ).write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in queries()["similar_part_texts"](spark, str(tmp_path)).collect()]
    texts = {re.sub("[^a-z0-9]+", " ", (n or "").lower()).strip() for n in names} - {""}
    want = {(a, b) for a in texts for b in texts if a < b and (
        SequenceMatcher(None, a, b).ratio() >= 0.8)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_confidence_rounds_like_the_exact_value(spark):
    rng = random.Random(3)
    values = [0.2578125, 0.3546875, 0.0, 1.0, 0.5, 1 / 3, 2 / 3, 0.1234565, 0.0078125, 0.9999995]
    values += [rng.randrange(0, 8000) / 8000 / 8 + rng.randrange(8) / 8 for _ in range(300)]
    values += [(2 * rng.randrange(500_000) + 1) / 2e6 for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", linkage._rounded(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in got] == [(v, round(v, 6)) for v in values]
