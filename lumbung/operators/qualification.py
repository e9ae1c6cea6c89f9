"""Promotion of many runs in one plan: every gate is computed from what the runs have stored.

Nothing here expects finished verdicts. Rows, recorded layouts, manifests, receipts, comparison
reports and requests come as tables keyed by run; the comparison with each run's own baseline is
made again and held against the stored report, count by count and id by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.digests import row_digest
from lumbung.operators import runlog
from lumbung.rules import lineage as R
from lumbung.session import cut_lineage

SALT = 64  # a baseline with a third of all rows meets its candidates in this many parts
SLICES = 4
REPORTED = ["added", "missing", "changed"]


@dataclass
class Evidence:
    """What the runs have stored.

    ``runs`` (run_id, root, position): the runs to judge, in order within their root.
    ``rows`` (run_id, id, content …): the rows of all run tables.
    ``layouts`` (run_id, position, name, type): the recorded columns; none means no table.
    ``manifests`` (run_id, manifest struct): null where it cannot be read.
    ``receipts``: the hash-chained logs.
    ``reports`` (run_id, report struct) and ``changes`` (run_id, id, change): the comparisons.
    ``requests`` (run_id, bound_run_id, expected_active): requests to promote a first snapshot.
    ``selection`` (root, active_run_id): what is committed.
    """

    runs: DataFrame
    rows: DataFrame
    layouts: DataFrame
    manifests: DataFrame
    receipts: DataFrame
    reports: DataFrame
    changes: DataFrame
    requests: DataFrame
    selection: DataFrame


# ---- rows of a run and of its baseline ---------------------------------------------------------
def key_facts(rows: DataFrame, pairs: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per (run_id, id): rows on either side, how the id changed, what was reported.

    ``pairs`` (run_id, baseline_run_id) names the baselines. Candidate rows, baseline rows and
    reported changes are put below each other and grouped once, so no side is joined by id. Only
    digests move, and a baseline is cut into SALT parts before it meets its candidates.
    """
    content = [c for c in rows.columns if c != "run_id"]
    hashed = rows.select("run_id", "id", row_digest(rows, content).alias("d"))
    parts = pairs.select(
        F.col("baseline_run_id").alias("of"), F.col("run_id").alias("candidate"),
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    part = F.pmod(F.xxhash64("id"), F.lit(SALT))
    text, none = F.lit(None).cast("string"), F.lit(0).cast("long")
    own = hashed.select("run_id", "id", F.col("d").alias("c"), text.alias("b"), text.alias("said"))
    base = hashed.join(parts, (F.col("run_id") == F.col("of")) & (part == F.col("salt"))).select(
        F.col("candidate").alias("run_id"), "id", text.alias("c"), F.col("d").alias("b"),
        text.alias("said"))
    both = own.unionAll(base)
    if changes is not None:
        both = both.unionAll(changes.select("run_id", "id", text, text, "change"))
    slices = [F.sum(F.coalesce(F.conv(F.substring("c", 1 + 8 * i, 8), 16, 10).cast("long"), none)
                    ).alias(f"s{i}") for i in range(SLICES)]
    keys = both.groupBy("run_id", "id").agg(
        F.count("c").alias("candidate_rows"), F.count("b").alias("baseline_rows"),
        F.max("c").alias("c"), F.max("b").alias("b"), F.count("said").alias("reports"),
        F.max("said").alias("said"), *slices)
    c, b = F.col("candidate_rows"), F.col("baseline_rows")
    change = (F.when((c > 1) | (b > 1), "duplicate").when((c == 0) & (b == 0), None)
              .when(b == 0, "added").when(c == 0, "missing")
              .when(F.col("c") != F.col("b"), "changed").otherwise("unchanged"))
    return keys.withColumn("change", change).drop("c", "b")


def run_facts(keys: DataFrame) -> DataFrame:
    """One row per run: table metrics, an order-free digest of its rows, the difference in counts,
    and how many ids the stored report gets wrong."""
    c, b, known = F.col("candidate_rows"), F.col("baseline_rows"), F.col("id").isNotNull()

    def ids(kind: str) -> Column:
        return F.count_if(known & (F.col("change") == kind))

    listed = F.col("change").isin(REPORTED) & known
    right = F.when(listed, (F.col("reports") == 1) & (F.col("said") == F.col("change"))).otherwise(
        F.col("reports") == 0)
    sums = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")) for i in range(SLICES)]
    digest = F.sha2(F.concat_ws(":", F.sum(c), *sums), 256)
    return keys.groupBy("run_id").agg(
        F.sum(c).alias("row_count"), F.count_if(known & (c > 0)).alias("distinct_id_count"),
        F.sum(F.when(known, 0).otherwise(c)).alias("null_id_count"),
        F.min(F.when(c > 0, F.col("id"))).alias("min_id"),
        F.max(F.when(c > 0, F.col("id"))).alias("max_id"), digest.alias("sha256"),
        F.sum(b).alias("baseline_row_count"), ids("added").alias("ids_added_count"),
        ids("missing").alias("ids_missing_count"), ids("changed").alias("ids_changed_count"),
        (ids("changed") + ids("unchanged")).alias("shared_id_count"),
        F.count_if((F.col("change") == "duplicate") | (~known & (c + b > 0))).alias(
            "unusable_ids"),
        F.count_if(~F.coalesce(right, F.lit(False))).alias("misreported_ids"))


def no_rows() -> dict[str, Column]:
    """The facts of a table without rows."""
    zero = F.lit(0).cast("long")
    counts = ["row_count", "distinct_id_count", "null_id_count", "baseline_row_count",
              "ids_added_count", "ids_missing_count", "ids_changed_count", "shared_id_count",
              "unusable_ids", "misreported_ids"]
    out = {name: F.coalesce(name, zero) for name in counts}
    out["sha256"] = F.coalesce("sha256", F.sha2(F.lit(":".join("0" * (SLICES + 1))), 256))
    return out


def comparison(observed: str, baseline: str) -> dict[str, Column]:
    """The fields of a comparison report, from the facts of a run and of its baseline."""
    o, b = F.col(observed), F.col(baseline)
    return {
        "baseline_run_id": b["run_id"], "baseline_sha256": b["sha256"],
        "candidate_sha256": o["sha256"], "baseline_row_count": o["baseline_row_count"],
        "candidate_row_count": o["row_count"],
        "row_count_difference": o["row_count"] - o["baseline_row_count"],
        "ids_added_count": o["ids_added_count"], "ids_missing_count": o["ids_missing_count"],
        "ids_changed_count": o["ids_changed_count"], "shared_id_count": o["shared_id_count"],
        "baseline_source_count": b["source_count"], "candidate_source_count": o["source_count"],
        "source_count_difference": o["source_count"] - b["source_count"],
    }


# ---- gates -------------------------------------------------------------------------------------
def evaluate(evidence: Evidence, expected_layout: list[tuple[str, str]], table_name: str,
             endpoint: str) -> DataFrame:
    """One row per run: mode, observed facts and one boolean per gate of either mode.

    A run with a request is judged as a first snapshot, every other one against its baseline.
    Unknown counts as failed. Everything after the row digests has one row per run.
    """
    e = evidence
    pairs = e.reports.select("run_id", F.col("report.baseline_run_id")).where(
        "baseline_run_id is not null")
    facts = cut_lineage(run_facts(key_facts(e.rows, pairs, e.changes)))
    layouts = e.layouts.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "name", "type"))),
        lambda x: F.concat_ws(" ", x["name"], x["type"])).alias("layout"))
    stored = e.runs.join(layouts, "run_id", "left").join(facts, "run_id", "left").join(
        e.manifests, "run_id", "left").withColumns(no_rows()).withColumn(
        "source_count", F.col("manifest.source_records_filtered"))
    seen = ["run_id", "layout", "source_count", *[c for c in facts.columns if c != "run_id"]]
    observed = stored.select("run_id", "root", "position", "manifest",
                             F.when(F.col("layout").isNotNull(), F.struct(*seen)).alias("o"))
    baselines = observed.select(F.col("run_id").alias("baseline_run_id"), F.col("o").alias("b"))
    requests = e.requests.groupBy("run_id").agg(
        F.count("*").alias("requests"), F.bool_and(F.col("expected_active").isNull() & (
            F.col("bound_run_id") == F.col("run_id"))).alias("bound"))
    chains = runlog.verify_chains(e.receipts).select("run_id", F.struct(
        "promotion_valid", "terminal_hash", "table_digest", "canonical_total", "last_source",
        "retry_total").alias("chain"))
    runs = observed.join(e.reports, "run_id", "left").withColumn(
        "baseline_run_id", F.col("report.baseline_run_id")).join(
        baselines, "baseline_run_id", "left").join(chains, "run_id", "left").join(
        requests, "run_id", "left").join(
        e.selection.select("root", F.lit(True).alias("selected")), "root", "left")

    m, o, b, chain, report = (F.col(c) for c in ("manifest", "o", "b", "chain", "report"))
    first = F.col("requests").isNotNull()
    # A request authorises once: a second one for the same run is a replay.
    authority = F.col("bound") & (F.col("requests") == 1) & F.col("selected").isNull()
    named = runlog.manifest_checks("manifest", "o", table_name)
    consistent = F.lit(True)
    for name in ("run_id", "table_name", "row_count", "distinct_id_count", "min_id", "max_id"):
        consistent = consistent & named[name]
    bound = ((m["chain_head"] == chain["terminal_hash"]) & (m["sha256"] == chain["table_digest"])
             & (m["run_id"] == F.col("run_id")) & (m["row_count"] == chain["canonical_total"])
             & (m["source_records_filtered"] == chain["last_source"])
             & (m["retries_used"].isNull() | (m["retries_used"] == chain["retry_total"])))
    same = ((report["status"] == "passed") & (o["layout"] == b["layout"])
            & b["source_count"].isNotNull() & o["source_count"].isNotNull()
            & (o["unusable_ids"] == 0) & (o["misreported_ids"] == 0))
    for name, value in comparison("o", "b").items():
        same = same & report[name].eqNullSafe(value)
    expected = F.array(*[F.lit(f"{name} {kind}") for name, kind in expected_layout])
    gates = {
        "manifest_exists": m.isNotNull(),
        "duckdb_exists": o.isNotNull(),
        "schema_valid": o["layout"] == expected,
        "row_count_nonzero": o["row_count"] > 0,
        "unique_ids": o["distinct_id_count"] == o["row_count"],
        "no_null_ids": o["null_id_count"] == 0,
        "manifest_consistent": consistent,
        "sha256_verified": m["sha256"] == o["sha256"],
        "source_count_recorded": m["source_records_filtered"] > 0,
        "full_source_count_collected": m["source_records_filtered"] == o["row_count"],
        "collection_gates_recorded_passed": (F.size(m["validation"]) > 0) & F.forall(
            F.map_values(m["validation"]), lambda v: v == "passed"),
        "receipt_chain_valid": chain["promotion_valid"] & (
            chain["table_digest"] == o["sha256"]) & (m.isNull() | bound),
        "comparison_report_available": report.isNotNull(),
        "comparison_report_valid": same,
        "genesis_context_valid": authority,
        "genesis_selection_state_valid": authority,
        **runlog.genesis_checks("manifest", "o", endpoint),
        R.FINAL_GATE: ~m["promotion_eligible"],
    }
    known = b["layout"].isNotNull() & o["layout"].isNotNull()
    return runs.select(
        "run_id", "root", "position", F.when(first, "GENESIS").otherwise("STEADY_STATE").alias(
            "mode"), o["row_count"].alias("row_count"), o["sha256"].alias("table_digest"),
        *[F.when(known, o[c]).alias(c) for c in (
            "ids_added_count", "ids_missing_count", "ids_changed_count")],
        *[F.coalesce(c, F.lit(False)).alias(g) for g, c in gates.items()])


def gate_rows(judged: DataFrame) -> DataFrame:
    """(run_id, mode, position, gate, verdict): 19 rows for a first snapshot, 15 for others."""
    def listed(mode: str) -> Column:
        return F.array(*[F.struct(
            F.lit(i).alias("position"), F.lit(g).alias("gate"),
            F.when(F.col(g), "PASS").otherwise("FAIL").alias("verdict"))
            for i, g in enumerate(runlog.promotion_gates(mode))])

    both = F.when(F.col("mode") == "GENESIS", listed("GENESIS")).otherwise(listed("STEADY_STATE"))
    return judged.select("run_id", "mode", F.explode(both).alias("g")).select(
        "run_id", "mode", "g.*")


def verdicts(judged: DataFrame) -> DataFrame:
    """Eligibility and the ordered failing gates of every run, without a further shuffle."""
    def failing(mode: str) -> Column:
        return F.array_compact(F.array(*[
            F.when(~F.col(g), F.lit(g)) for g in runlog.promotion_gates(mode)]))

    failures = F.when(F.col("mode") == "GENESIS", failing("GENESIS")).otherwise(
        failing("STEADY_STATE"))
    facts = [c for c in judged.columns if c not in (
        set(runlog.promotion_gates("GENESIS")) | set(R.STEADY_GATES))]
    return judged.select(*facts, failures.alias("failures")).withColumn(
        "promotion_eligible", F.size("failures") == 0)


def promote(judged: DataFrame, selection: DataFrame, claims: DataFrame) -> DataFrame:
    """Per root: the newest eligible run becomes active, the committed one the rollback.

    ``claims`` (root, expected_active) holds what each caller believes to be active. A stale claim
    and a root without a new eligible run leave the committed selection as it is.
    """
    newest = judged.where("promotion_eligible").groupBy("root").agg(
        F.max_by("run_id", "position").alias("newest"))
    j = claims.join(newest, "root", "left").join(
        selection.select("root", F.col("active_run_id").alias("committed")), "root", "left")
    stale = ~F.col("expected_active").eqNullSafe(F.col("committed"))
    none = F.col("newest").isNull() | F.col("newest").eqNullSafe(F.col("committed"))
    status = F.when(stale, "stale expectation").when(none, "nothing new").otherwise("promoted")
    done = status == "promoted"
    return j.select("root", status.alias("status"), F.when(done, F.col("newest")).otherwise(
        F.col("committed")).alias("active_run_id"), F.when(done, F.col("committed")).alias(
        "rollback_run_id"))
