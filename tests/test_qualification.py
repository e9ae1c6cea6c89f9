"""Promotion of runs: each gate has a run that fails it, and rows decide, not stored verdicts."""

import os
from dataclasses import fields, replace

import pytest
from pyspark.sql import functions as F

from lumbung.operators import qualification as Q
from lumbung.operators import runlog
from lumbung.plans import qualification as P

FOLDER = os.environ.get("LUMBUNG_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def evidence(spark):
    return P.stored_runs(spark, FOLDER)


def judged(evidence):
    return Q.evaluate(evidence, P.LAYOUT, "sirup_raw", P.ENDPOINT)


def failures(evidence):
    return {r.run_id: r.failures for r in Q.verdicts(judged(evidence)).collect()}


def test_every_gate_fails_somewhere(evidence):
    gates = Q.gate_rows(judged(evidence)).collect()
    for mode in ("GENESIS", "STEADY_STATE"):
        names = runlog.promotion_gates(mode)
        runs = {r.run_id for r in gates if r["mode"] == mode}
        for run in runs:
            own = sorted((r.position, r.gate) for r in gates if r.run_id == run)
            assert [g for _, g in own] == names
    failed = {r.gate for r in gates if r.verdict == "FAIL"}
    assert failed == set(runlog.promotion_gates("GENESIS")) | set(
        runlog.promotion_gates("STEADY_STATE"))


def test_rows_decide(evidence):
    """One changed value of one row breaks digest, receipts and comparison of its run alone."""
    before = failures(evidence)
    assert before["run-0"] == before["run-1"] == []
    touched = evidence.rows.withColumn("pagu", F.when(
        (F.col("run_id") == "run-1") & (F.col("id") == 2), 77.0).otherwise(F.col("pagu")))
    after = failures(replace(evidence, rows=touched))
    assert after["run-1"] == ["sha256_verified", "receipt_chain_valid", "comparison_report_valid"]
    # run-1 is also the baseline of the later runs of its root.
    assert "comparison_report_valid" in after["run-8"] and after["run-0"] == []


def test_reports_are_held_against_ids(evidence):
    """Right counts with wrong ids do not pass; neither does an id reported twice."""
    moved = evidence.changes.withColumn("id", F.when(
        F.col("run_id") == "run-1", F.col("id") + 1000).otherwise(F.col("id")))
    assert failures(replace(evidence, changes=moved))["run-1"] == ["comparison_report_valid"]
    twice = evidence.changes.unionAll(evidence.changes.where("run_id = 'run-1'"))
    assert failures(replace(evidence, changes=twice))["run-1"] == ["comparison_report_valid"]


def test_empty_tables(evidence):
    none = {f.name: getattr(evidence, f.name).limit(0) for f in fields(evidence)}
    assert failures(Q.Evidence(**none)) == {}
    only_runs = Q.Evidence(**{**none, "runs": evidence.runs.where("run_id = 'run-1'")})
    assert failures(only_runs) == {"run-1": runlog.promotion_gates("STEADY_STATE")}


def test_promotion_and_rollback(spark):
    runs = spark.createDataFrame(
        [("a1", "a", 1, True), ("a2", "a", 2, True), ("a3", "a", 3, False), ("b1", "b", 1, True),
         ("c1", "c", 1, True), ("c2", "c", 2, True), ("d1", "d", 1, False)],
        "run_id string, root string, position int, promotion_eligible boolean")
    selection = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("c", "c1")],
                                      "root string, active_run_id string")
    claims = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("c", None), ("d", None)],
                                   "root string, expected_active string")
    got = {r.root: tuple(r)[1:] for r in Q.promote(runs, selection, claims).collect()}
    assert got == {"a": ("promoted", "a2", "a1"), "b": ("nothing new", "b1", None),
                   "c": ("stale expectation", "c1", None), "d": ("nothing new", None, None)}
    fresh = Q.promote(runs, selection.limit(0), claims.withColumn("expected_active", F.lit(
        None).cast("string")))
    assert {r.root: tuple(r)[1:] for r in fresh.collect()}["a"] == ("promoted", "a2", None)


def test_stored_runs_hash_their_rows_once(spark):
    """Reports and changes follow from one stored comparison of the rows with their baselines."""
    from lumbung.plans import qualification
    changes = qualification.stored_runs(spark, FOLDER).changes
    assert "Aggregate" not in changes._jdf.queryExecution().optimizedPlan().toString()
