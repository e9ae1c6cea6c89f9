from functools import reduce

import pytest
from pyspark.sql import functions as F

from lumbung.functions.text import display_name
from lumbung.operators import authority, contracts, prospects, routing, runlog, scan, snapshot
from lumbung.streaming import folds

CONTACT = dict(
    source_file="verified_cache_contacts_1640.csv", source_type="verified_cache",
    source_priority=4, source_confidence=0.5, source_row=1, institution_name="Dinas Pendidikan",
    parent_organization="Pemerintah Kota A", region="Jawa Barat", contact_email="a@x.id",
    official_website="", contact_phone="", contact_whatsapp="", contact_person="",
    contact_role="", contact_notes="", contact_source_url="https://x.id", contact_source_type="v",
    endpoint_organization="Dinas Pendidikan", endpoint_binding_explicit=True,
    completeness_score=10.0)
TARGET = dict(id=1, institution_name="Dinas Pendidikan", work_unit="Dinas Pendidikan",
              parent_organization="Pemerintah Kota A", province_or_region="Jawa Barat",
              location_hint="")


def shown(df):
    return df.withColumn("institution_display_name", display_name(
        F.col("work_unit"), F.col("parent_organization")))


def enrich(spark, contacts, target):
    rows = [{**CONTACT, **c} for c in contacts]
    c = spark.createDataFrame([{**r, "work_unit": r["institution_name"]} for r in rows])
    c = shown(c).withColumn("match_keys", authority.match_keys())
    t = shown(spark.createDataFrame([{**TARGET, **target}]))
    return authority.enrich_outreach(t, authority.authority_index(c), "id").first()


@pytest.mark.parametrize("contacts,target,kind,status,scope", [
    ([{}], {}, "exact_display_name", "CONTACT_FOUND", "DIRECT_INSTITUTION"),
    ([{"parent_organization": "Pemerintah Kota B"}], {}, "unmatched", "CONTACT_MISSING",
     "UNRESOLVED"),
    ([{"region": "Jawa Timur"}], {}, "unmatched", "CONTACT_MISSING", "UNRESOLVED"),
    ([{"parent_organization": "", "region": ""}], {}, "unmatched", "CONTACT_MISSING",
     "UNRESOLVED"),
    ([{}, {"region": "", "contact_email": "b@x.id", "completeness_score": 99.0}], {},
     "institution_name_region", "CONTACT_FOUND", "DIRECT_INSTITUTION"),
    ([{"contact_source_url": ""}], {}, "exact_display_name", "CONTACT_NEEDS_REVIEW",
     "UNRESOLVED"),
    ([{"endpoint_organization": "Pemerintah Kota A"}], {}, "exact_display_name",
     "CONTACT_FOUND", "HIERARCHY_OFFICIAL"),
    ([{}, {"region": "Jawa Timur"}], {"province_or_region": ""}, "unmatched",
     "CONTACT_MISSING", "UNRESOLVED"),
    ([{}], {"province_or_region": ""}, "exact_display_name", "CONTACT_FOUND",
     "DIRECT_INSTITUTION"),
])
def test_authority_cases(spark, contacts, target, kind, status, scope):
    for order in (contacts, contacts[::-1]):
        row = enrich(spark, order, target)
        assert (row.contact_match_type, row.contact_status, row.contact_scope) == (
            kind, status, scope)


AGENCY = dict(canonical_kldi_id="D294", source_kldi_name="Kab. Halmahera Tengah",
              acquisition_run_id="run", receipt_chain_reference="ref", receipt_chain_hash="h",
              source_version="v1", province="Maluku Utara", government_level="Kabupaten")
PORTAL = dict(lpse_name="LPSE Kabupaten Halmahera Tengah", official_lpse_url="https://p/1",
              registry_artifact_id="a", registry_artifact_hash="b", registry_version="c",
              province="Maluku Utara", government_level="Pemerintah Kabupaten")


@pytest.mark.parametrize("agency,portals,status,reasons", [
    ({}, [{}], "ROUTING_ACTIVE", []),
    ({}, [{}, {"official_lpse_url": "https://p/2"}], "ROUTING_AMBIGUOUS",
     ["NORMALIZED_CANDIDATE_COUNT_NOT_ONE"]),
    ({}, [{"lpse_name": "LPSE Kota X"}], "ROUTING_REJECTED", ["NO_EXACT_NORMALIZED_CANDIDATE"]),
    ({"province": "Aceh"}, [{}], "ROUTING_REJECTED", ["PROVINCE_CONFLICT"]),
    ({"government_level": "Kota"}, [{}], "ROUTING_REJECTED", ["GOVERNMENT_LEVEL_CONFLICT"]),
    ({"receipt_chain_hash": ""}, [{"registry_version": " "}], "ROUTING_REJECTED",
     ["MISSING_REGISTRY_REGISTRY_VERSION", "MISSING_SIRUP_RECEIPT_CHAIN_HASH"]),
    ({}, [{}, {"lpse_name": "Other"}], "ROUTING_REJECTED", ["LPSE_URL_NOT_UNIQUE"]),
])
def test_routing_cases(spark, agency, portals, status, reasons):
    bound = routing.bind_routes(spark.createDataFrame([{**AGENCY, **agency}]),
                                spark.createDataFrame([{**PORTAL, **p} for p in portals]))
    row = bound.first()
    assert (row.status, row.rejection_reasons) == (status, reasons)
    assert routing.routes(bound).count() == (status == "ROUTING_ACTIVE")
    stale = routing.validate_routes(bound, source_version="v2").first()
    assert stale.status == ("ROUTING_STALE" if status == "ROUTING_ACTIVE" else status)


# ---- run log ---------------------------------------------------------------------------------
def drafts(pages=3, retry=False, resume=False):
    import json

    out = [("ANCHOR", {"full_snapshot": True, "page_size": 2})]
    done = 0
    for i in range(pages):
        if retry and i == 1:
            out.append(("RETRY", {"start": done, "page_size": 2, "retry_index": 1,
                                  "error_class": "E"}))
        out.append(("PAGE", {"start": done, "page_size": 2, "returned_row_count": 2,
                             "canonical_row_count": 1, "quarantined_row_count": 1,
                             "page_rows_digest": "a" * 64, "source_count_observed": 2 * pages}))
        done += 2
        if resume and i == 1:
            out.append(("RESUME", {
                "processed": done, "next_start": done, "last_completed_page": 2,
                "retries": int(retry), "checkpoint_snapshot": {
                    "source_rows_processed": done, "next_start": done,
                    "last_completed_page": 2, "retries_used": int(retry)}}))
    out.append(("COMPLETION", {
        "terminal_reason": "NORMAL_COMPLETION", "processed": done, "canonical_total": pages,
        "quarantine_total": pages, "source_count_start": done, "source_count_end": done,
        "drift_status": "NO_DRIFT", "promotion_flag": False}))
    return [("run", i, kind, "2026-01-01T00:00:00.000Z", json.dumps(p))
            for i, (kind, p) in enumerate(out)]


DRAFT = "run_id string, position bigint, receipt_type string, timestamp string, payload string"


def chain(spark, rows):
    empty = spark.createDataFrame([], "run_id string, sequence bigint, hash string")
    return runlog.append_receipts(empty, spark.createDataFrame(rows, DRAFT))


@pytest.mark.parametrize("options", [{}, {"retry": True}, {"retry": True, "resume": True}])
def test_whole_chains_are_valid(spark, options):
    row = runlog.verify_chains(chain(spark, drafts(**options)), block=2).first()
    assert (row.valid, row.promotion_valid, row.failures) == (True, True, [])
    assert row.retry_total == int("retry" in options)


def swap(rows, kind, old, new):
    return [(*r[:4], r[4].replace(old, new)) if r[2] == kind else r for r in rows]


@pytest.mark.parametrize("change,rule", [
    (lambda r: r[:-1], "receipt chain has no terminal receipt"),
    (lambda r: r[1:], "first receipt is not ANCHOR"),
    (lambda r: swap(r, "RETRY", '"start": 2', '"start": 4'), "RETRY prefix binding mismatch"),
    (lambda r: swap(r, "RETRY", '"retry_index": 1', '"retry_index": 2'),
     "RETRY prefix binding mismatch"),
    (lambda r: swap(r, "RESUME", '"processed": 4', '"processed": 2'),
     "RESUME prefix accounting mismatch"),
    (lambda r: swap(r, "PAGE", '"canonical_row_count": 1', '"canonical_row_count": 2'),
     "PAGE accounting mismatch"),
    (lambda r: swap(r, "COMPLETION", "NO_DRIFT", "DRIFT"), "invalid completion payload"),
    (lambda r: [*r, (*r[1][:1], 99, *r[1][2:])], "receipt exists after terminal"),
    (lambda r: swap(r, "PAGE", "a" * 64, "xyz"), "invalid page_rows_digest"),
])
def test_broken_chains_name_the_rule(spark, change, rule):
    rows = change(drafts(retry=True, resume=True))
    row = runlog.verify_chains(chain(spark, rows), block=3).first()
    assert rule in row.failures and not row.valid


def test_edited_receipts_break_the_hash(spark):
    log = chain(spark, drafts())
    edited = log.withColumn("hash", F.when(F.col("sequence") == 1, F.sha2("hash", 256)).otherwise(
        F.col("hash")))
    assert runlog.verify_chains(edited).first().failures == [
        "receipt hash mismatch", "receipt previous_hash mismatch"]


def test_gates_and_selection(spark):
    assert len(runlog.promotion_gates("STEADY_STATE")) == 15
    assert len(runlog.promotion_gates("GENESIS")) == 19
    gates = runlog.promotion_gates("GENESIS")
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string").withColumns(
        {g: (F.col("run_id") != "r3") | F.lit(g != "unique_ids") for g in gates})
    verdicts = runlog.promotion_verdict(runlog.gate_table(runs, "GENESIS"))
    assert {r.run_id: r.failures for r in verdicts.collect()} == {
        "r1": [], "r2": [], "r3": ["unique_ids"]}
    assert runlog.select_snapshot(verdicts, "run_id", None).first().active_run_id == "r2"
    current = spark.createDataFrame([("r1",)], "active_run_id string")
    row = runlog.select_snapshot(verdicts, "run_id", "r1", current).first()
    assert (row.active_run_id, row.rollback_run_id) == ("r2", "r1")
    assert runlog.select_snapshot(verdicts, "run_id", "r0", current).isEmpty()


def test_first_snapshot_gates(spark):
    manifest = dict(
        manifest_version=1, status="validated_staging_sample", full_snapshot=True,
        promotion_eligible=False, promotion_result="not_in_scope", source_endpoint="https://s",
        requested_year=2026, requested_limit=5, page_size=2, page_count=3, request_count=3,
        retries_used=0, source_records_filtered=5, started_at="2026-01-01T00:00:00Z",
        collected_at="2026-01-02T00:00:00Z",
        validation={c: "passed" for c in runlog.COLLECTOR_CHECKS})
    wrong = {"genesis_manifest_contract_valid": {"status": "x"},
             "genesis_full_source_accounting_valid": {"source_records_filtered": 6,
                                                      "requested_limit": 6},
             "genesis_collection_provenance_valid": {"page_count": 2},
             "genesis_promotion_state_valid": {"promotion_eligible": True}}
    schema = "manifest_version int, status string, full_snapshot boolean, " \
        "promotion_eligible boolean, promotion_result string, source_endpoint string, " \
        "requested_year int, requested_limit bigint, page_size bigint, page_count bigint, " \
        "request_count bigint, retries_used int, source_records_filtered bigint, " \
        "started_at string, collected_at string, validation map<string,string>"
    names = [f.split()[0] for f in schema.split(", ")]
    for gate, change in [(None, {}), *wrong.items()]:
        row = {**manifest, **change}
        df = spark.createDataFrame([tuple(row[n] for n in names)], schema).select(
            F.struct("*").alias("m"), F.struct(F.lit(5).alias("row_count")).alias("o"))
        checks = runlog.genesis_checks("m", "o", "https://s")
        got = df.select(*[c.alias(n) for n, c in checks.items()]).first().asDict()
        assert {n for n, ok in got.items() if not ok} == ({gate} if gate else set())


# ---- scans, differences, logs ------------------------------------------------------------------
@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_blocked_scan_equals_a_plain_fold(spark, block, inclusive):
    rows = [(k, i * 3 + ord(k) % 2, i if i % 4 else None) for k in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "k string, at bigint, v int").repartition(5)
    out = scan.running(df, ["k"], "at", {"s": F.col("v")}, {"l": F.col("v")}, inclusive, block)
    got = {(r.k, r["at"]): (r.s, r.l) for r in out.collect()}
    for key in "ab":
        total, last = 0, None
        for k, at, v in rows:
            if k != key:
                continue
            after = (total + (v or 0), v if v is not None else last)
            assert got[k, at] == (after if inclusive else (total, last))
            total, last = after


def test_diff_reports_duplicates_and_schema(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "z"), (3, None), (4, "n")], "id int, v string")
    got = {r.id: r.change for r in snapshot.diff(a, b, "id").collect()}
    assert got == {1: "changed", 2: "duplicate", 3: "unchanged", 4: "added"}
    with pytest.raises(ValueError):
        snapshot.diff(a, b.withColumnRenamed("v", "w"), "id")


def test_decisions_bind_exactly(spark):
    prov = F.struct(*[F.lit(v).alias(k) for k, v in dict(
        source_kind="LPSE", source_locator="l", observed_at="2026-01-01T00:00:00Z",
        acquisition_id="a", raw_receipt_id="r", schema_version="1",
        source_maturity="TRUSTED_ACQUISITION").items()])
    rows = spark.createDataFrame([("e1", "p1", "t"), ("e2", " ", "t")],
                                 "execution_id string, source_package_id string, "
                                 "package_title string").withColumn("provenance", prov)
    log = contracts.decide(rows, "EXECUTION", F.lit("2026"), F.array(F.lit("x")))
    assert log.count() == 1
    assert contracts.contains_exact(log, log).count() == 1
    assert contracts.contains_exact(log, log.withColumn("bindings", F.lit("{}"))).count() == 0
    assert contracts.appendable(log, log).count() == 0
    other = log.withColumns({"bindings": F.lit("{}"), "decision_id": F.lit("n")})
    assert contracts.appendable(log, other).count() == 0
    seen = {r.execution_id: r.verified for r in contracts.verified_by(
        rows, log, "EXECUTION").collect()}
    assert seen == {"e1": True, "e2": False}


def test_prospects_are_typed(spark):
    df = spark.createDataFrame([("Dinas X", "", "12", None)],
                               "institution_name string, institution_display_name string, "
                               "total_relevant_packages string, total_pagu string")
    row = prospects.to_prospects(df).first()
    assert (row.institution_display_name, row.total_relevant_packages, row.total_pagu) == (
        "Dinas X", 12, 0.0)


def test_results_do_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(f"i{n % 3}", n, f"f{n % 2}") for n in range(30)],
                                 "institution_id string, seq bigint, evidence_fingerprint string")
    shapes = [rows, rows.repartition(7, "seq"), rows.orderBy(F.desc("seq")).coalesce(1)]
    outs = [sorted(map(tuple, folds.current_verifications(r, block=5).collect())) for r in shapes]
    assert reduce(lambda a, b: a if a == b else None, outs) is not None
