"""Queries that judge runs for promotion; every gate fails in some run and for its own cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.operators import qualification as Q
from lumbung.operators import runlog
from lumbung.plans.registry import query
from lumbung.plans.views import table
from lumbung.session import cut_lineage

LAYOUT = [("id", "BIGINT"), ("pagu", "DOUBLE"), ("pemilihan", "VARCHAR"), ("idSatker", "BIGINT")]
ENDPOINT = "https://plans.example/search"
FIRST = [0, 17, 18, 19, 20, 21, 22, 25]  # faults of first snapshots
FAULTS = 26  # runs of a root, one per fault; the first two have none
ORDERS = 50  # orders a run has published


def run_name(number) -> F.Column:
    return F.concat(F.lit("run-"), number.cast("string"))


def run_rows(spark, sf_dir) -> DataFrame:
    """Fifty orders a run, some left out; one run of each root repeats an id, one has a null id."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.floor(key / ORDERS).alias("run"), (key % ORDERS + 1).alias("id"),
        (F.col("o_custkey") % 3).cast("double").alias("pagu"),
        F.col("o_orderstatus").alias("pemilihan"), (F.col("o_custkey") % 2).alias("idSatker")
    ).where((key * 7) % 13 != 0)
    fault = F.col("run") % FAULTS
    again = rows.where((fault == 6) & (F.col("id") % 25 == 2))
    nameless = rows.where((fault == 7) & (F.col("id") % 25 == 2)).withColumn(
        "id", F.lit(None).cast("long"))
    return rows.unionAll(again).unionAll(nameless)


def stored_runs(spark, sf_dir) -> Q.Evidence:
    """Tables, manifests, receipts and reports of runs; the run number's remainder is its fault."""
    rows = run_rows(spark, sf_dir).select(run_name(F.col("run")).alias("run_id"), "*")
    fault = F.col("run") % FAULTS
    content = rows.drop("run")
    no_pairs = spark.createDataFrame([], "run_id string, baseline_run_id string")
    claimed = Q.run_facts(Q.key_facts(content, no_pairs)).select(
        "run_id", "row_count", "distinct_id_count", "min_id", "max_id", "sha256")
    numbers = rows.groupBy("run_id", "run").agg(F.lit(1).alias("one")).drop("one")
    claimed = cut_lineage(claimed.join(numbers, "run_id"))

    log = receipts(spark, claimed)
    heads = runlog.chain_facts(log).select("run_id", "terminal_hash")
    n = F.col("row_count")
    source = F.when(fault == 10, 0).when(fault.isin(11, 20), n + 1).otherwise(n)
    validation = F.map_from_arrays(
        F.array(*map(F.lit, runlog.COLLECTOR_CHECKS)), F.array(*[F.when(
            (fault == 12) & F.lit(c == "response_shape"), "failed").otherwise("passed")
            for c in runlog.COLLECTOR_CHECKS]))
    manifest = F.struct(
        F.lit(1).alias("manifest_version"), "run_id",
        F.when(fault == 19, "draft").otherwise("validated_staging_sample").alias("status"),
        F.lit(True).alias("full_snapshot"), fault.isin(16, 22).alias("promotion_eligible"),
        F.lit("not_in_scope").alias("promotion_result"), F.lit(ENDPOINT).alias("source_endpoint"),
        F.lit(2026).alias("requested_year"), n.alias("requested_limit"),
        F.lit(20).alias("page_size"),
        (F.ceil(n / 20) + F.when(fault == 21, 1).otherwise(0)).alias("page_count"),
        F.ceil(n / 20).alias("request_count"), F.lit("2026-01-01T00:00:00Z").alias("started_at"),
        F.lit("2026-01-01T01:00:00Z").alias("collected_at"),
        F.lit("sirup_raw").alias("table_name"), n.alias("row_count"), "distinct_id_count",
        "min_id", (F.col("max_id") + F.when(fault == 8, 1).otherwise(0)).alias("max_id"),
        source.alias("source_records_filtered"), F.lit(0).alias("retries_used"),
        F.when(fault == 9, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.col("terminal_hash").alias("chain_head"), validation.alias("validation"))
    manifests = claimed.join(heads, "run_id").select(
        "run_id", F.when(fault != 2, manifest).alias("manifest"))

    number = F.col("run")
    first = fault.isin(FIRST)
    root = F.floor(number / FAULTS)
    runs = claimed.select("run_id", root.alias("root"), number.alias("position"))
    columns = F.explode(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("name"),
        F.when((fault == 4) & F.lit(name == "pagu"), "VARCHAR").otherwise(kind).alias("type"))
        for i, (name, kind) in enumerate(LAYOUT)]))
    layouts = claimed.where(fault != 3).select("run_id", columns.alias("c")).select(
        "run_id", "c.*")
    stored = rows.where(~fault.isin(3, 5)).drop("run")

    base = run_name(F.when(fault == 24, F.lit(-1)).when(fault == 1, number - 1).otherwise(
        number - fault + 1))
    pairs = claimed.where(~first & (fault != 14)).select(
        "run_id", base.alias("baseline_run_id"))
    # Two tables follow from these facts; written once, the rows are hashed and met once.
    keys = cut_lineage(Q.key_facts(stored, pairs))
    reports = stored_reports(claimed, keys, pairs, manifests)
    changes = keys.join(pairs, "run_id", "left_semi").where(
        F.col("change").isin(Q.REPORTED) & F.col("id").isNotNull()).select(
        "run_id", "id", "change")
    gone = (F.split_part("run_id", F.lit("-"), F.lit(2)).cast("int") % FAULTS == 23) & (
        F.col("id") % 5 == 1)
    requests = claimed.where(first).select(
        "run_id", F.when(fault == 17, "run-x").otherwise(F.col("run_id")).alias("bound_run_id"),
        F.when(fault == 18, "run-x").alias("expected_active"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 25, 2).otherwise(1))).alias("copy"))
    selection = claimed.where((fault == 0) & (root % 2 == 1)).select(
        root.alias("root"), F.col("run_id").alias("active_run_id"))
    return Q.Evidence(runs, stored, layouts, manifests, log, cut_lineage(reports),
                      changes.where(~gone), requests.drop("copy"), selection)


def stored_reports(claimed, keys, pairs, manifests) -> DataFrame:
    """Reports as the comparison wrote them; one run of each root has a wrong count."""
    fault = F.col("run") % FAULTS
    facts = claimed.select("run_id", "run").join(
        Q.run_facts(keys), "run_id", "left").withColumns(Q.no_rows()).join(
        manifests, "run_id").withColumn("source_count", F.col("manifest.source_records_filtered"))
    observed = facts.select("run_id", "run", F.struct(*[
        c for c in facts.columns if c != "manifest"]).alias("o"))
    base = observed.select(F.col("run_id").alias("baseline_run_id"), F.col("o").alias("b"))
    fields = Q.comparison("o", "b")
    fields["baseline_run_id"] = F.col("baseline_run_id")
    fields["ids_added_count"] = fields["ids_added_count"] + F.when(fault == 15, 1).otherwise(0)
    return pairs.join(observed, "run_id").join(base, "baseline_run_id", "left").select(
        "run_id", F.struct(F.lit("passed").alias("status"), *[
            c.alias(name) for name, c in fields.items()]).alias("report"))


def receipts(spark, claimed) -> DataFrame:
    """A chained log per run: anchor, pages of twenty rows, completion; one in each root edited."""
    n = F.col("row_count")
    pages = claimed.select("run_id", n.alias("n"), F.explode(F.sequence(
        F.lit(0), F.ceil(n / 20) - 1)).alias("page")).select(
        "run_id", (F.col("page") + 1).alias("position"), F.lit("PAGE").alias("receipt_type"),
        F.to_json(F.struct(
            (F.col("page") * 20).alias("start"), F.lit(20).alias("page_size"),
            F.least(F.lit(20), F.col("n") - F.col("page") * 20).alias("returned_row_count"),
            F.least(F.lit(20), F.col("n") - F.col("page") * 20).alias("canonical_row_count"),
            F.lit(0).alias("quarantined_row_count"),
            F.sha2(F.col("run_id"), 256).alias("page_rows_digest"),
            F.col("n").alias("source_count_observed"))).alias("payload"))
    anchor = claimed.select("run_id", F.lit(0).cast("long").alias("position"), F.lit(
        "ANCHOR").alias("receipt_type"), F.lit('{"full_snapshot":true,"page_size":20}').alias(
        "payload"))
    done = claimed.select(
        "run_id", (F.ceil(n / 20) + 1).alias("position"), F.lit("COMPLETION").alias(
            "receipt_type"), F.to_json(F.struct(
                F.lit("NORMAL_COMPLETION").alias("terminal_reason"), n.alias("processed"),
                n.alias("canonical_total"), F.lit(0).alias("quarantine_total"),
                n.alias("source_count_start"), n.alias("source_count_end"),
                F.lit("NO_DRIFT").alias("drift_status"), F.lit(False).alias("promotion_flag"),
                F.col("sha256").alias("duckdb_sha256"))).alias("payload"))
    drafts = anchor.unionByName(pages).unionByName(done).withColumn(
        "timestamp", F.lit("2026-01-01T00:00:00.000Z"))
    empty = spark.createDataFrame([], "run_id string, sequence bigint, hash string")
    log = runlog.append_receipts(empty, drafts)
    number = F.split_part("run_id", F.lit("-"), F.lit(2)).cast("int")
    edited = F.replace("payload", F.lit('"start":20'), F.lit('"start":21'))
    return cut_lineage(log.withColumn("payload", F.when(
        number % FAULTS == 13, edited).otherwise(F.col("payload"))))


def judged_runs(spark, sf_dir) -> tuple[DataFrame, Q.Evidence]:
    evidence = stored_runs(spark, sf_dir)
    return Q.evaluate(evidence, LAYOUT, "sirup_raw", ENDPOINT), evidence


# What fails for each fault; a first snapshot under a committed selection has no authority.
_CAUSES = {
    2: "manifest_exists manifest_consistent sha256_verified source_count_recorded "
       "full_source_count_collected collection_gates_recorded_passed comparison_report_valid "
       "promotion_flag_remains_false",
    3: "duckdb_exists schema_valid row_count_nonzero unique_ids no_null_ids manifest_consistent "
       "sha256_verified full_source_count_collected receipt_chain_valid comparison_report_valid",
    4: "schema_valid comparison_report_valid",
    5: "row_count_nonzero manifest_consistent sha256_verified full_source_count_collected "
       "receipt_chain_valid",
    6: "unique_ids comparison_report_valid", 7: "unique_ids no_null_ids comparison_report_valid",
    8: "manifest_consistent", 9: "sha256_verified receipt_chain_valid",
    10: "source_count_recorded full_source_count_collected receipt_chain_valid",
    11: "full_source_count_collected receipt_chain_valid",
    12: "collection_gates_recorded_passed", 13: "receipt_chain_valid",
    14: "comparison_report_available comparison_report_valid", 15: "comparison_report_valid",
    16: "promotion_flag_remains_false", 17: "AUTHORITY", 18: "AUTHORITY",
    19: "genesis_manifest_contract_valid",
    20: "full_source_count_collected receipt_chain_valid AUTHORITY "
        "genesis_full_source_accounting_valid genesis_collection_provenance_valid",
    21: "genesis_collection_provenance_valid",
    22: "genesis_promotion_state_valid promotion_flag_remains_false",
    23: "comparison_report_valid", 24: "comparison_report_valid", 25: "AUTHORITY",
}
_GATES = runlog.promotion_gates("GENESIS")[:12] + ["AUTHORITY"] + runlog.promotion_gates(
    "GENESIS")[14:18] + ["comparison_report_available", "comparison_report_valid",
                         "promotion_flag_remains_false"]


def _failing(gate: str) -> str:
    faults = [f for f, names in _CAUSES.items() if gate in names.split()]
    if gate == "AUTHORITY":
        own = ", ".join(str(f) for f in (17, 18, 25))
        return (f"(f IN ({own}) OR (first AND root % 2 = 1))")
    return f"f IN ({', '.join(map(str, faults))})"


_RUNS = f"""
 WITH r0 AS (SELECT o_orderkey // {ORDERS} AS run, o_orderkey % {ORDERS} + 1 AS id,
   o_custkey % 3 AS pagu, o_orderstatus AS p, o_custkey % 2 AS s FROM orders
   WHERE (o_orderkey * 7) % 13 <> 0),
 r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r0 WHERE run % {FAULTS} = 6 AND id % 25 = 2
   UNION ALL SELECT run, NULL, pagu, p, s FROM r0 WHERE run % {FAULTS} = 7 AND id % 25 = 2),
 runs AS (SELECT DISTINCT run, run % {FAULTS} AS f, run // {FAULTS} AS root,
   run % {FAULTS} IN ({', '.join(map(str, FIRST))}) AS first FROM r),
 t AS (SELECT * FROM r WHERE run % {FAULTS} NOT IN (3, 5)),
 h AS (SELECT run, sha256('{{"id":' || coalesce(CAST(id AS VARCHAR), 'null') || ',"idSatker":' || s
   || ',"pagu":"' || pagu || '.000000","pemilihan":"' || p || '"}}') AS d FROM t),
 g AS (SELECT run, count(*) AS n, {', '.join(
     f"sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS s{i}" for i in range(4))}
   FROM h GROUP BY 1),
 pairs AS (SELECT run, CASE WHEN f = 1 THEN run - 1 ELSE run - f + 1 END AS base FROM runs
   WHERE NOT first AND f NOT IN (3, 14, 24)),
 c AS (SELECT pairs.run, id, min(pagu || p || s) AS v, count(*) AS n FROM pairs JOIN t USING (run)
   GROUP BY ALL),
 b AS (SELECT pairs.run, id, min(pagu || p || s) AS v FROM pairs JOIN t ON t.run = base
   GROUP BY ALL),
 x AS (SELECT coalesce(c.run, b.run) AS run, coalesce(c.n, 1) AS n, CASE WHEN b.id IS NULL THEN 'a'
   WHEN c.id IS NULL THEN 'm' WHEN c.v <> b.v THEN 'c' END AS k
   FROM (SELECT * FROM c WHERE id IS NOT NULL) c FULL JOIN b ON b.run = c.run AND b.id = c.id),
 d AS (SELECT run, count(*) FILTER (k = 'a' AND n = 1) AS ids_added_count,
   count(*) FILTER (k = 'm') AS ids_missing_count, count(*) FILTER (k = 'c' AND n = 1)
   AS ids_changed_count FROM x GROUP BY 1),
 v AS (SELECT runs.*, 'run-' || run AS run_id, CASE WHEN first THEN 'GENESIS' ELSE 'STEADY_STATE'
   END AS mode, list_filter([{', '.join(
       f"CASE WHEN {_failing(g)} THEN "
       + ("'genesis_context_valid; genesis_selection_state_valid'" if g == "AUTHORITY"
          else f"'{g}'") + " END" for g in _GATES)}], lambda y: y IS NOT NULL) AS failing
   FROM runs)"""


@query("run_qualification", _RUNS + """
 SELECT run_id, root, mode, CASE WHEN f <> 3 THEN coalesce(n, 0) END AS row_count,
  CASE WHEN f <> 3 THEN sha256(coalesce(n, 0) || ':' || coalesce(s0, 0) || ':' || coalesce(s1, 0)
   || ':' || coalesce(s2, 0) || ':' || coalesce(s3, 0)) END AS table_digest,
  ids_added_count, ids_missing_count, ids_changed_count, len(failing) = 0 AS promotion_eligible,
  array_to_string(failing, '; ') AS failures
 FROM v LEFT JOIN g USING (run) LEFT JOIN d USING (run)""")
def run_qualification(spark, sf_dir):
    """Every run's verdict, computed from rows, layouts, manifests, receipts and reports."""
    judged, _ = judged_runs(spark, sf_dir)
    return Q.verdicts(judged).drop("position").withColumn(
        "failures", F.array_join("failures", "; "))


@query("gate_table", _RUNS + """
 , names AS (SELECT mode, unnest(gates) AS gate, generate_subscripts(gates, 1) - 1 AS position
   FROM (VALUES ('GENESIS', [""" + ", ".join(
    f"'{g}'" for g in runlog.promotion_gates("GENESIS")) + """]), ('STEADY_STATE', [""" + ", ".join(
    f"'{g}'" for g in runlog.promotion_gates("STEADY_STATE")) + """])) AS m(mode, gates))
 SELECT run_id, mode, CAST(position AS INTEGER) AS position, gate, CASE WHEN contains(
  '; ' || array_to_string(failing, '; ') || ';', '; ' || gate || ';') THEN 'FAIL' ELSE 'PASS' END
  AS verdict FROM v JOIN names USING (mode)""")
def gate_table(spark, sf_dir):
    """The ordered gates of every run: 19 of a first snapshot, 15 of the others."""
    return Q.gate_rows(judged_runs(spark, sf_dir)[0])


@query("promoted_runs", _RUNS + f"""
 , newest AS (SELECT root, max(run) AS run FROM v WHERE len(failing) = 0 GROUP BY 1),
 roots AS (SELECT root, bool_or(f = 0) AND root % 2 = 1 AS held FROM runs GROUP BY 1),
 j AS (SELECT root, newest.run AS newest, CASE WHEN held THEN root * {FAULTS} END AS committed
   FROM roots LEFT JOIN newest USING (root)),
 k AS (SELECT *, CASE WHEN root % 4 = 3 THEN 'stale expectation' WHEN newest IS NULL OR newest =
   committed THEN 'nothing new' ELSE 'promoted' END AS status FROM j)
 SELECT root, status, 'run-' || CASE WHEN status = 'promoted' THEN newest ELSE committed END
   AS active_run_id, CASE WHEN status = 'promoted' THEN 'run-' || committed END AS rollback_run_id
 FROM k""")
def promoted_runs(spark, sf_dir):
    """Active and rollback run of every root; one caller in four has a stale expectation."""
    judged, evidence = judged_runs(spark, sf_dir)
    claims = evidence.runs.select("root").distinct().join(
        evidence.selection, "root", "left").select("root", F.when(
            F.col("root") % 4 == 3, "run-x").otherwise(F.col("active_run_id")).alias(
            "expected_active"))
    return Q.promote(Q.verdicts(judged), evidence.selection, claims)
