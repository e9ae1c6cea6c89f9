"""Queries over snapshots, pages, run logs and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.functions.digests import dataset_digest
from lumbung.operators import runlog, snapshot
from lumbung.plans.registry import query
from lumbung.plans.views import packages, table, with_packages
from lumbung.session import cut_lineage


# ---- snapshot metrics, checks, differences ---------------------------------------------------
@query("snapshot_metrics", """
    SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_id_count,
      count(*) FILTER (l_orderkey IS NULL) AS null_id_count, min(l_orderkey) AS min_id,
      max(l_orderkey) AS max_id FROM lineitem""")
def snapshot_metrics(spark, sf_dir):
    return snapshot.metrics(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("snapshot_checks", """
    SELECT * FROM (VALUES (0, 'schema', 'PASS'), (1, 'row_count', 'PASS')) t(position, gate,
      verdict) UNION ALL SELECT 2, 'unique_ids', CASE WHEN count(DISTINCT l_orderkey) = count(*)
      THEN 'PASS' ELSE 'FAIL' END FROM lineitem UNION ALL SELECT 3, 'null_ids',
      CASE WHEN count(l_orderkey) = count(*) THEN 'PASS' ELSE 'FAIL' END FROM lineitem""")
def snapshot_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return snapshot.checks(rows, "l_orderkey", rows.schema)


def order_versions(spark, sf_dir):
    """All orders, and a later version with dropped, changed and new ones."""
    base = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = base.where(key % 11 != 0)
    changed = kept.withColumn("o_totalprice", F.when(key % 7 == 0, F.col("o_totalprice") + 1)
                              .otherwise(F.col("o_totalprice")))
    new = base.where(key % 13 == 0).withColumn("o_orderkey", -key - 1)
    return base, changed.unionByName(new)


_DIFF = """
 WITH c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0
            UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 13 = 0),
 d AS (SELECT coalesce(b.o_orderkey, c.id) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL
        THEN 'added' WHEN c.id IS NULL THEN 'missing' WHEN c.id % 7 = 0 THEN 'changed'
        ELSE 'unchanged' END AS change,
        CASE WHEN b.o_orderkey IS NULL THEN 0 ELSE 1 END AS bn,
        CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS cn
       FROM orders b FULL JOIN c ON b.o_orderkey = c.id)"""


@query("snapshot_diff", _DIFF + " SELECT o_orderkey, change FROM d")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*order_versions(spark, sf_dir), "o_orderkey").select(
        "o_orderkey", "change")


@query("snapshot_diff_summary", _DIFF + """
 SELECT sum(bn) AS baseline_row_count, sum(cn) AS candidate_row_count,
   sum(cn) - sum(bn) AS row_count_difference,
   count(*) FILTER (change = 'added') AS ids_added_count,
   count(*) FILTER (change = 'missing') AS ids_missing_count,
   count(*) FILTER (change = 'changed') AS ids_changed_count,
   count(*) FILTER (change IN ('changed', 'unchanged')) AS shared_id_count,
   0 AS duplicate_id_count FROM d""")
def snapshot_diff_summary(spark, sf_dir):
    return snapshot.diff_summary(snapshot.diff(*order_versions(spark, sf_dir), "o_orderkey"))


@query("dataset_digest", """
 SELECT count(*) AS row_count, TRUE AS same_after_shuffle, TRUE AS differs_after_change
 FROM orders""")
def dataset_digest_query(spark, sf_dir):
    """The digest ignores row order and partitioning and sees a changed value."""
    rows = table(spark, sf_dir, "orders")
    changed = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 5, 0.0).otherwise(
        F.col("o_totalprice")))
    own = dataset_digest(rows, rows.columns)
    other = dataset_digest(rows.repartition(13, "o_custkey"), rows.columns)
    moved = dataset_digest(changed, rows.columns)
    return own.select(
        "row_count",
        (F.col("digest") == other.select("digest").scalar()).alias("same_after_shuffle"),
        (F.col("digest") != moved.select("digest").scalar()).alias("differs_after_change"))


# ---- pagination ------------------------------------------------------------------------------
def event_pages(spark, sf_dir):
    """Events as descending pages of 100; some ids repeat the one before them."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / 100).alias("page"), (e % 100).alias("position"),
        (-e - F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)).alias("id"),
        F.when(e < 900, 1000).otherwise(1001).alias("source_count"))


_PAGES = """
 WITH e AS (SELECT event_id // 100 AS page, event_id % 100 AS position,
   -event_id - CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS id,
   CASE WHEN event_id < 900 THEN 1000 ELSE 1001 END AS source_count FROM events),
 s AS (SELECT *, lag(id) OVER (PARTITION BY page ORDER BY position) AS prev FROM e),
 p AS (SELECT page, count(*) AS rows_received, arg_min(id, position) AS first_id,
   arg_max(id, position) AS last_id, count(*) FILTER (prev <= id) AS order_faults FROM s
   GROUP BY 1),
 b AS (SELECT *, coalesce(lag(last_id) OVER (ORDER BY page) <= first_id, FALSE)
   AS boundary_fault FROM p)"""


@query("pagination_check", _PAGES + """
 SELECT page, rows_received, first_id, last_id, order_faults, boundary_fault FROM b""")
def pagination_check(spark, sf_dir):
    return snapshot.page_bounds(event_pages(spark, sf_dir)).select(
        "page", "rows_received", "first_id", "last_id", "order_faults", "boundary_fault")


@query("pagination_summary", _PAGES + """
 SELECT (SELECT count(*) FROM b) AS pages,
  (SELECT count(*) FROM b WHERE rows_received <> 100) AS page_size_failures,
  (SELECT count(*) FROM b WHERE order_faults > 0) AS pages_out_of_order,
  (SELECT count(*) FROM b WHERE boundary_fault) AS boundary_faults,
  (SELECT count(*) FROM (SELECT id FROM e GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM (SELECT id FROM e GROUP BY 1 HAVING count(DISTINCT page) > 1))
    AS overlapping_ids, FALSE AS passed""")
def pagination_summary(spark, sf_dir):
    return snapshot.pagination_summary(event_pages(spark, sf_dir), 100).drop(
        "source_count_consistent")


@query("page_overlaps", _PAGES + """
 , r AS (SELECT id, count(DISTINCT page) AS pages FROM e GROUP BY 1
         HAVING count(DISTINCT page) > 1)
 SELECT DISTINCT id, page, pages FROM e JOIN r USING (id)""")
def page_overlaps(spark, sf_dir):
    return snapshot.page_overlaps(event_pages(spark, sf_dir))


@query("offset_gaps", """
 WITH s AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id
   ORDER BY event_id) AS prev FROM events)
 SELECT user_id, event_id, coalesce(prev + 1, 0) AS expected FROM s
 WHERE event_id <> coalesce(prev + 1, 0)""")
def offset_gaps(spark, sf_dir):
    return snapshot.offset_gaps(table(spark, sf_dir, "events"), ["user_id"], "event_id",
                                block=4000)


@query("conversation_turn_gaps", """
 WITH s AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev
            FROM conversations)
 SELECT conv_id, turn, coalesce(prev + 1, 0) AS expected FROM s
 WHERE turn <> coalesce(prev + 1, 0)""")
def conversation_turn_gaps(spark, sf_dir):
    return snapshot.offset_gaps(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


# ---- pages, quarantine, accounting -----------------------------------------------------------
REQUIRED = ["id", "kind", "value"]


def source_pages(spark, sf_dir):
    """Event pages of 50 as payload JSON; rows miss fields, have null or repeated ids."""
    e = F.col("event_id")
    shown_id = F.when(F.col("user_id") % 10 == 3, e - 1).otherwise(e)
    good = F.to_json(F.struct(shown_id.alias("id"), F.col("event_type").alias("kind"),
                              F.col("user_id").alias("value")))
    row = (
        F.when(F.col("event_type") == "error", F.to_json(F.struct(
            shown_id.alias("id"), F.col("user_id").alias("value"))))
        .when(e % 17 == 0, F.concat(F.lit('{"id":null,"kind":"x","value":1}')))
        .when(e % 19 == 0, F.lit("[1,2]")).otherwise(good))
    rows = table(spark, sf_dir, "events").select(
        F.floor(e / 50).alias("page"), (e % 50).alias("position"), row.alias("row"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(
        F.struct("position", "row"))).alias("rows"))  # a page holds at most 50 rows
    n = table(spark, sf_dir, "events").agg(F.count("*")).scalar()
    total = F.when(F.col("page") % 23 == 5, F.lit('"many"')).otherwise(n.cast("string"))
    payload = F.concat(F.lit('{"data":['), F.array_join(F.transform(
        "rows", lambda x: x["row"]), ","), F.lit('],"recordsFiltered":'), total, F.lit("}"))
    return pages.select(
        F.concat(F.lit("run-"), (F.col("page") % 4).cast("string")).alias("run_id"),
        (F.col("page") * 50).alias("page_start"), F.lit(50).cast("long").alias(
            "requested_length"), F.col("page").alias("page_draw"), payload.alias("payload"))


def classified_rows(spark, sf_dir):
    parsed = runlog.parse_pages(source_pages(spark, sf_dir))
    return runlog.classify_rows(runlog.page_rows(parsed), REQUIRED)


_SPLIT = """
 WITH e AS (SELECT event_id // 50 AS page, event_id % 50 AS position, event_id,
   event_type = 'error' AS no_kind,
   event_type <> 'error' AND event_id % 17 = 0 AS null_id,
   event_type <> 'error' AND event_id % 17 <> 0 AND event_id % 19 = 0 AS no_object,
   CASE WHEN user_id % 10 = 3 THEN event_id - 1 ELSE event_id END AS shown FROM events),
 i AS (SELECT *, CASE WHEN null_id OR no_object THEN NULL ELSE shown END AS id FROM e
       WHERE page % 23 <> 5),
 r AS (SELECT *, id IS NOT NULL AND count(*) OVER (PARTITION BY page, id) > 1 AS repeated
       FROM i),
 v AS (SELECT page, position, page % 4 AS run, event_id, id, array_to_string(list_filter([
   CASE WHEN no_object THEN 'row ' || position || ' is not an object' END,
   CASE WHEN no_kind THEN 'row ' || position || ' is missing fields: kind' END,
   CASE WHEN null_id THEN 'row ' || position || ' has a null id' END,
   CASE WHEN repeated THEN 'row ' || position || ' has a duplicate id: ' || id END],
   lambda x: x IS NOT NULL), '; ') AS validation_error FROM r)"""


@query("page_split", _SPLIT + """
 SELECT event_id AS source_offset, validation_error, validation_error = '' AS is_valid FROM v""")
def page_split(spark, sf_dir):
    return classified_rows(spark, sf_dir).select("source_offset", "validation_error", "is_valid")


@query("page_failures", """
 SELECT DISTINCT event_id // 50 * 50 AS start,
  'response field ''recordsFiltered'' is not an integer' AS validation_error
 FROM events WHERE event_id // 50 % 23 = 5""")
def page_failures(spark, sf_dir):
    return runlog.page_failures(runlog.parse_pages(source_pages(spark, sf_dir))).select(
        "start", "validation_error")


@query("running_accounting", _SPLIT + """
 , a AS (SELECT run, page, count(*) AS n, count(*) FILTER (validation_error = '') AS c FROM v
         GROUP BY 1, 2)
 SELECT 'run-' || run AS run_id, page * 50 AS page_start,
   sum(n) OVER w AS source_rows_processed, sum(c) OVER w AS canonical_rows_collected,
   sum(n - c) OVER w AS quarantine_rows, TRUE AS balanced FROM a
 WINDOW w AS (PARTITION BY run ORDER BY page)""")
def running_accounting(spark, sf_dir):
    return runlog.page_accounting(classified_rows(spark, sf_dir), block=2000).select(
        "run_id", "page_start", "source_rows_processed", "canonical_rows_collected",
        "quarantine_rows", "balanced")


@query("quarantine_records", _SPLIT + """
 SELECT event_id AS source_offset, validation_error, TRUE AS intact FROM v
 WHERE validation_error <> ''""")
def quarantine_records(spark, sf_dir):
    records = runlog.quarantine_records(classified_rows(spark, sf_dir), F.lit("2026-01-01"),
                                        F.lit("failures"))
    broken = runlog.record_violations(records, "quarantine_record_id")
    return records.join(broken, "quarantine_record_id", "left").select(
        "source_offset", "validation_error", F.col("violations").isNull().alias("intact"))


@query("provenance_records", _SPLIT + """
 SELECT 'run-' || run AS run_id, CASE WHEN validation_error = '' THEN 'canonical'
   ELSE 'quarantine' END AS disposition, count(*) AS records, count(*) AS distinct_records
 FROM v GROUP BY 1, 2""")
def provenance_records(spark, sf_dir):
    records = runlog.provenance_records(classified_rows(spark, sf_dir), F.lit("2026-01-01"))
    return records.groupBy("run_id", "disposition").agg(
        F.count("*").alias("records"),
        F.count_distinct("provenance_record_id").alias("distinct_records"))


@query("failure_audit", """
 SELECT 'kind' AS field, count(*) AS rows FROM events
 WHERE event_type = 'error' AND event_id // 50 % 23 <> 5""")
def failure_audit(spark, sf_dir):
    rows = runlog.page_rows(runlog.parse_pages(source_pages(spark, sf_dir)))
    objects = rows.where(F.from_json("raw_row", "map<string,string>").isNotNull())
    return runlog.missing_field_frequency(objects, REQUIRED)


@query("repeated_ids", _SPLIT + """
 , k AS (SELECT CAST(id AS VARCHAR) AS package_id, event_id FROM v WHERE id IS NOT NULL),
   c AS (SELECT package_id, count(*) AS occurrences FROM k GROUP BY 1 HAVING count(*) > 1)
 SELECT event_id AS source_offset, package_id, occurrences FROM k JOIN c USING (package_id)""")
def repeated_ids(spark, sf_dir):
    rows = runlog.page_rows(runlog.parse_pages(source_pages(spark, sf_dir)))
    return runlog.repeated_ids(rows, ["source_offset"])


@query("json_props_profile", """
 SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS rows,
  round(sum(value), 2) AS value FROM events GROUP BY 1""")
def json_props_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.from_json("props", "struct<k:bigint>").alias("p"), "value")
    return rows.groupBy((F.col("p.k") % 10).alias("k")).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("value"))


@query("storage_rows", with_packages("""
 SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE "idBulan" END AS month_number,
  CASE WHEN id % 5 = 0 THEN 'idBulan is not an exact integer value' END AS coercion_error, pagu
 FROM packages"""))
def storage_rows(spark, sf_dir):
    p = packages(spark, sf_dir)
    odd = p.withColumn("idBulan", F.when(F.col("id") % 5 == 0, F.col("idBulan") + 0.5).otherwise(
        F.col("idBulan").cast("double")))
    rows = odd.select(F.to_json(F.struct(*odd.columns)).alias("raw_row"))
    return runlog.storage_rows(rows).select(
        "id", F.col("idBulan").alias("month_number"), "coercion_error", "pagu")


# ---- replay ----------------------------------------------------------------------------------
def replay_batches(spark, sf_dir):
    """Orders as batches of 50 against a store that lacks some rows and has others changed."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    batch_no = F.floor(key / 50)
    batch = rows.withColumn("batch", batch_no)
    stored = rows.where(~((batch_no % 4 == 1) | ((batch_no % 4 == 2) & (key % 2 == 0))))
    stored = stored.withColumn("o_orderstatus", F.when((batch_no % 4 == 3) & (key % 50 == 7),
                                                       "X").otherwise(F.col("o_orderstatus")))
    return batch, stored


@query("replay_state", """
 SELECT o_orderkey // 50 AS batch, count(*) AS expected_count,
  count(*) FILTER (NOT (o_orderkey // 50 % 4 = 1 OR (o_orderkey // 50 % 4 = 2
    AND o_orderkey % 2 = 0))) AS observed_count,
  CASE o_orderkey // 50 % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'absent' WHEN 2 THEN 'partial'
    ELSE 'conflict' END AS state FROM orders GROUP BY o_orderkey // 50""")
def replay_state(spark, sf_dir):
    batch, stored = replay_batches(spark, sf_dir)
    return snapshot.replay_state(batch, stored, "o_orderkey", "batch")


@query("replay_append", "SELECT o_orderkey FROM orders WHERE o_orderkey // 50 % 4 = 1")
def replay_append(spark, sf_dir):
    batch, stored = replay_batches(spark, sf_dir)
    return snapshot.rows_to_append(batch, stored, "o_orderkey", "batch").select("o_orderkey")


def resume_runs(spark, sf_dir):
    """Checkpoints that agree with the stored rows, trail them by five or twelve, or lead."""
    run = F.col("o_orderkey") % 40
    name = F.concat(F.lit("run-"), run.cast("string"))
    rows = table(spark, sf_dir, "orders").select(name.alias("run_id"), run.alias("run"),
                                                 F.col("o_orderkey").alias("id"))
    lag = F.when(F.col("run") % 4 == 1, 5).when(F.col("run") % 4 == 2, -3).when(
        F.col("run") % 4 == 3, 12).otherwise(0)
    checkpoint = rows.groupBy("run_id", "run").agg(F.count("*").alias("n")).select(
        "run_id", (F.col("n") - lag).alias("canonical_rows_collected"),
        F.lit(0).alias("quarantine_rows"))
    quarantine = rows.where(F.col("id") < 0).select(
        "run_id", F.col("id").alias("quarantine_record_id"))
    return checkpoint, rows, quarantine


@query("resume_state", """
 SELECT 'run-' || (o_orderkey % 40) AS run_id, CASE o_orderkey % 40 % 4 WHEN 0 THEN 'consistent'
  WHEN 1 THEN 'replay_candidate' WHEN 2 THEN 'error: canonical rows trail the checkpoint'
  ELSE 'error: ahead by more than one page' END AS state FROM orders GROUP BY o_orderkey % 40""")
def resume_state(spark, sf_dir):
    return runlog.resume_state(*resume_runs(spark, sf_dir), 10).select("run_id", "state")


@query("verified_replay", """
 WITH g AS (SELECT o_orderkey % 40 AS run, count(*) AS n FROM orders GROUP BY 1)
 SELECT 'run-' || run AS run_id, CASE run % 4 WHEN 1 THEN 5 WHEN 2 THEN -3 WHEN 3 THEN 12 ELSE 0
  END AS canonical_ahead_count, CASE WHEN run % 8 = 1 THEN 5 ELSE 4 END AS page_canonical,
  run % 8 = 1 AS verified FROM g""")
def verified_replay(spark, sf_dir):
    """Runs ahead of their checkpoint against the page that is fetched again: every second run
    that is one page ahead has exactly that page's rows more."""
    checkpoint, rows, quarantine = resume_runs(spark, sf_dir)
    states = runlog.resume_state(checkpoint, rows, quarantine, 10)
    keep = F.when(F.col("run") % 8 == 1, 5).otherwise(4)
    page = rows.groupBy("run_id", "run").agg(F.count("*").alias("n")).select(
        "run_id", F.explode(F.sequence(F.lit(1), keep)).alias("i")).withColumn(
        "is_valid", F.lit(True))
    return runlog.verified_replay(states, page).select(
        "run_id", "canonical_ahead_count", "page_canonical", "verified")


# ---- run log ---------------------------------------------------------------------------------
def run_logs(spark, sf_dir):
    """One chained log per 40 events: anchor, one page per event, completion; some tampered with."""
    e = F.col("event_id")
    run = F.floor(e / 40)
    sixty_four = F.sha2(e.cast("string"), 256)
    events = table(spark, sf_dir, "events").select(run.alias("run"), (e % 40 + 1).alias(
        "position"), (e % 40 * 10).alias("start"), F.when(run % 7 == 3, F.when(
            e % 40 == 20, 9).otherwise(10)).otherwise(10).alias("n"), sixty_four.alias("digest"))
    sizes = events.groupBy("run").agg(F.count("*").alias("pages"), F.sum("n").alias("rows"))
    page = events.join(sizes.select("run", "rows"), "run").select(
        "run", "position", F.lit("PAGE").alias("receipt_type"), F.to_json(F.struct(
            "start", F.lit(10).alias("page_size"), F.col("n").alias("returned_row_count"),
            (F.col("n") - 1).alias("canonical_row_count"), F.lit(1).alias(
                "quarantined_row_count"), F.col("digest").alias("page_rows_digest"),
            F.col("rows").alias("source_count_observed"))).alias("payload"))
    anchor = sizes.select("run", F.lit(0).cast("long").alias("position"), F.lit("ANCHOR").alias(
        "receipt_type"), F.lit('{"full_snapshot":true,"page_size":10}').alias("payload"))
    done = sizes.select(
        "run", (F.col("pages") + 1).alias("position"), F.lit("COMPLETION").alias("receipt_type"),
        F.to_json(F.struct(
            F.lit("NORMAL_COMPLETION").alias("terminal_reason"), F.col("rows").alias("processed"),
            (F.col("rows") - F.col("pages")).alias("canonical_total"),
            F.col("pages").alias("quarantine_total"), F.col("rows").alias("source_count_start"),
            F.col("rows").alias("source_count_end"), F.lit("NO_DRIFT").alias("drift_status"),
            F.lit(False).alias("promotion_flag"))).alias("payload"))
    drafts = anchor.unionByName(page).unionByName(done).withColumns({
        "run_id": F.concat(F.lit("run-"), F.col("run").cast("string")),
        "timestamp": F.lit("2026-01-01T00:00:00.000Z")})
    empty = spark.createDataFrame([], "run_id string, sequence bigint, hash string")
    log = runlog.append_receipts(empty, drafts)
    number = F.split_part("run_id", F.lit("-"), F.lit(2)).cast("int")
    edited = F.replace("payload", F.lit('"start":30'), F.lit('"start":31'))
    log = log.withColumn("payload", F.when(number % 7 == 1, edited).otherwise(F.col("payload")))
    # A log is a stored table; the checks below read it several times.
    return cut_lineage(log.where(~((number % 7 == 2) & (F.col("sequence") == 6))))


@query("hash_chain_verify", """
 WITH r AS (SELECT event_id // 40 AS run, count(*) AS pages FROM events GROUP BY 1)
 SELECT 'run-' || run AS run_id, run % 7 NOT IN (1, 2, 3) AS valid,
  CASE WHEN run % 7 = 2 THEN pages * 10 - 10 WHEN run % 7 = 3 THEN pages * 10 - 1
   ELSE pages * 10 END AS processed,
  CASE run % 7 WHEN 1 THEN 'PAGE offset discontinuity; receipt hash mismatch'
   WHEN 2 THEN 'PAGE offset discontinuity; full snapshot source count mismatch; global accounting mismatch; receipt previous_hash mismatch; receipt sequence mismatch'
   WHEN 3 THEN 'short PAGE before completion' ELSE '' END AS failures FROM r""")
def hash_chain_verify(spark, sf_dir):
    return runlog.verify_chains(run_logs(spark, sf_dir), block=16).select(
        "run_id", "valid", "processed", F.array_join("failures", "; ").alias("failures"))


@query("chain_heads", """
 WITH b AS (SELECT event_id // 40 AS run, event_id % 40 AS i, event_id FROM events),
 z AS (SELECT run, count(*) AS pages, sum(CASE WHEN run % 7 = 3 AND i = 20 THEN 9 ELSE 10 END)
       AS rows FROM b GROUP BY 1),
 d AS (SELECT run, 0 AS pos, 'ANCHOR' AS t, '{"full_snapshot":true,"page_size":10}' AS p FROM z
  UNION ALL SELECT run, i + 1, 'PAGE', '{"start":' || (i * 10) || ',"page_size":10,' ||
   '"returned_row_count":' || n || ',"canonical_row_count":' || (n - 1) ||
   ',"quarantined_row_count":1,"page_rows_digest":"' || sha256(CAST(event_id AS VARCHAR)) ||
   '","source_count_observed":' || rows || '}' FROM (SELECT b.*, rows, CASE WHEN run % 7 = 3
   AND i = 20 THEN 9 ELSE 10 END AS n FROM b JOIN z USING (run))
  UNION ALL SELECT run, pages + 1, 'COMPLETION', '{"terminal_reason":"NORMAL_COMPLETION",' ||
   '"processed":' || rows || ',"canonical_total":' || (rows - pages) || ',"quarantine_total":'
   || pages || ',"source_count_start":' || rows || ',"source_count_end":' || rows ||
   ',"drift_status":"NO_DRIFT","promotion_flag":false}' FROM z),
 c AS (SELECT run, list('run-' || run || chr(31) || pos || chr(31) || t || chr(31) ||
   '2026-01-01T00:00:00.000Z' || chr(31) || '#' || chr(31) || p ORDER BY pos) AS steps FROM d
   GROUP BY 1)
 SELECT 'run-' || run AS run_id, list_reduce(list_prepend(sha256('RECEIPT-CHAIN-V1-GENESIS'),
   steps), lambda h, s: sha256(replace(s, chr(31) || '#' || chr(31), chr(31) || h || chr(31))))
   AS terminal_hash FROM c""")
def chain_heads(spark, sf_dir):
    return runlog.chain_facts(run_logs(spark, sf_dir)).select("run_id", "terminal_hash")


@query("manifest_checks", """
 WITH o AS (SELECT l_suppkey AS run, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT 'run-' || run AS run_id, array_to_string(list_filter([
  CASE WHEN run % 4 = 1 THEN 'row_count' END, CASE WHEN run % 4 = 2 THEN 'max_id' END,
  CASE WHEN run % 4 = 3 THEN 'staging_only' END], lambda x: x IS NOT NULL), ';') AS failed,
  n AS row_count FROM o""")
def manifest_checks(spark, sf_dir):
    """Supplier shipments as runs whose manifests are wrong in one field each."""
    key = F.concat(F.lit("run-"), F.col("l_suppkey").cast("string")).alias("run_id")
    metrics = table(spark, sf_dir, "lineitem").groupBy(key, "l_suppkey").agg(
        F.count("*").alias("row_count"), F.count_distinct("l_orderkey").alias(
            "distinct_id_count"), F.min("l_orderkey").alias("min_id"),
        F.max("l_orderkey").alias("max_id"), F.lit("ab").alias("sha256"))
    fault = F.col("l_suppkey") % 4
    manifest = F.struct(
        "run_id", F.lit("sirup_raw").alias("table_name"), F.col("row_count").alias(
            "requested_limit"), F.lit(True).alias("full_snapshot"),
        F.col("row_count").alias("source_records_filtered"),
        (F.col("row_count") + F.when(fault == 1, 1).otherwise(0)).alias("row_count"),
        "distinct_id_count", "min_id",
        (F.col("max_id") - F.when(fault == 2, 1).otherwise(0)).alias("max_id"), "sha256",
        (fault == 3).alias("promotion_eligible"), F.lit("not_in_scope").alias(
            "promotion_result"))
    runs = metrics.select("run_id", manifest.alias("m"), F.struct(
        "run_id", "row_count", "distinct_id_count", "min_id", "max_id", "sha256").alias("o"))
    named = runlog.manifest_checks("m", "o", "sirup_raw")
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))
    return runs.select("run_id", F.array_join(failed, ";").alias("failed"), "o.row_count")


@query("active_snapshot", """
 WITH r AS (SELECT l_suppkey AS run FROM lineitem GROUP BY 1
            HAVING sum(l_quantity) > 100)
 SELECT l_suppkey AS supplier, count(*) AS rows FROM lineitem
 WHERE l_suppkey = (SELECT max(run) FROM r) GROUP BY 1""")
def active_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "run_id", F.format_string("run-%010d", "l_suppkey"))
    verdicts = rows.groupBy("run_id").agg((F.sum("l_quantity") > 100).alias(
        "promotion_eligible"))
    chosen = runlog.select_snapshot(verdicts, "run_id", None)
    return runlog.active_rows(rows, chosen).groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count("*").alias("rows"))


# ---- deduplication and upsert ----------------------------------------------------------------
@query("dedup_union_keywords", """
 WITH k AS (SELECT doc_id, lower(trim(regexp_replace(source, '[^A-Za-z0-9]+', ' ', 'g'))) AS code,
   lang FROM documents)
 SELECT code, lang AS source_type, min(doc_id) AS first_doc,
   array_to_string(list_sort(list_distinct(list('k' || (doc_id % 7)))), ';') AS matched_keywords
 FROM k GROUP BY 1, 2""")
def dedup_union_keywords(spark, sf_dir):
    word = F.concat(F.lit("k"), (F.col("doc_id") % 7).cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("package_code"), F.col("lang").alias("source_type"),
        word.alias("keyword"), word.alias("matched_keywords"))
    return snapshot.dedup_union_keywords(rows, "doc_id").select(
        F.col("package_code").alias("code"), "source_type", F.col("doc_id").alias("first_doc"),
        "matched_keywords")


@query("dedup_packages", """
 SELECT l_orderkey, l_linenumber, min(rn) AS position FROM (SELECT l_orderkey, l_linenumber,
   l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS rn FROM lineitem)
 GROUP BY 1, 2""")
def dedup_packages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000
         + F.col("l_quantity").cast("long")).alias("position"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("package_code"),
        *[F.lit("").alias(c) for c in ("package_name", "institution_name", "stage_or_status",
                                       "hps_or_pagu", "method")])
    return snapshot.dedup_packages(rows, "position").select(
        "l_orderkey", "l_linenumber", "position")


@query("upsert_counts", """
 WITH a AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN -l_partkey ELSE l_partkey END AS k
            FROM lineitem), n AS (SELECT k, count(*) AS c FROM a GROUP BY 1),
 j AS (SELECT n.*, p_partkey IS NULL AS is_new FROM n LEFT JOIN part ON p_partkey = k)
 SELECT count(*) FILTER (is_new) AS inserted, CAST(sum(c) AS BIGINT) - count(*) FILTER (is_new)
   AS updated, count(*) FILTER (is_new) + (SELECT count(*) FROM part) AS total FROM j""")
def upsert_counts(spark, sf_dir):
    key = F.when(F.col("l_partkey") % 3 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    incoming = table(spark, sf_dir, "lineitem").select(key.alias("id"))
    existing = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return snapshot.upsert_counts(existing, incoming, "id")


@query("upsert_rows", """
 WITH i AS (SELECT l_partkey AS id, arg_max(l_quantity, l_orderkey * 100000 + l_suppkey * 10
   + l_linenumber) AS q FROM lineitem GROUP BY 1)
 SELECT coalesce(id, p_partkey) AS id, coalesce(q, p_retailprice) AS price
 FROM part FULL JOIN i ON id = p_partkey""")
def upsert_rows(spark, sf_dir):
    incoming = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_quantity").alias("price"),
        (F.col("l_orderkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias(
            "position"))
    existing = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return snapshot.upsert(existing, incoming, "id", "position")
