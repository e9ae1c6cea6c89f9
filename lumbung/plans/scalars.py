"""Column functions and small folds that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.functions import numbers
from lumbung.functions import text as X
from lumbung.operators import (contracts, linkage, products, prospects, qualification, runlog,
                               summaries)
from lumbung.plans import acquisition
from lumbung.plans.linking import _SCORED, letter_evidence, letter_plans, stem_text
from lumbung.plans.outreach_events import _E, events
from lumbung.plans.registry import query
from lumbung.plans.views import pick, pick_sql, table


@query("month_labels", """
 SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS label FROM orders""")
def month_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.month_label(
        F.col("o_orderdate")).alias("label"))


@query("amount_similarity", """
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE
  greatest(0.0, 1.0 - abs(l_extendedprice - l_quantity * 1500) / greatest(abs(l_extendedprice),
  abs(l_quantity * 1500), 1.0)) END AS score FROM lineitem""")
def amount_similarity(spark, sf_dir):
    other = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") * 1500)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.budget_similarity(
            F.col("l_extendedprice"), other).alias("score"))


@query("rupiah_display", """
 SELECT o_orderkey, 'Rp' || chr(160) || replace(format('{:,}', o_orderkey * 1234567), ',', '.')
  AS shown FROM orders""")
def rupiah_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.rupiah(
        F.col("o_orderkey") * 1234567).alias("shown"))


@query("mapping_scores", """
 WITH p AS (SELECT p_partkey, 4 + p_partkey % 13 AS a, p_partkey % 3 AS t,
   4 + (p_partkey * 7) % 13 AS b, p_partkey % 4 AS u, 4 + (p_partkey * 5) % 13 AS c FROM part)
 SELECT p_partkey, 2.0 * least(a, b) / (a + t + b + u) AS institution,
  greatest(2.0 * least(a, b) / (a + t + b + u), 2.0 * least(a, c) / (a + t + c)) AS name,
  p_partkey % 2 = 0 AS same_year FROM p""")
def mapping_scores(spark, sf_dir):
    k = F.col("p_partkey")
    own = stem_text(4 + k % 13, k % 3, "x")
    other = stem_text(4 + (k * 7) % 13, k % 4, "y")
    stage = stem_text(4 + (k * 5) % 13, F.lit(0), "y")
    return table(spark, sf_dir, "part").select(
        "p_partkey", linkage.institution_score([own, F.lit("")], other).alias("institution"),
        linkage.name_score(own, other, stage).alias("name"),
        linkage.same_year(F.lit(2026), 2026 + k % 2).alias("same_year"))


@query("accepted_identities", _SCORED + """
 SELECT CAST(d.id AS VARCHAR) AS plan_id, 'S' || d.id AS id_satker FROM d
 JOIN r ON d.id = r.id AND rn = 1 WHERE d.status = 'CONFIRMED_MATCH' AND i AND u""")
def accepted_identities(spark, sf_dir):
    plans = letter_plans(spark, sf_dir)
    decided = linkage.resolve_identity(plans, letter_evidence(spark, sf_dir))
    ids = plans.select("plan_id", F.concat(F.lit("S"), "plan_id").alias("id_satker"),
                       F.lit("K").alias("id_kldi"), F.col("satker").alias("institution_name"))
    return contracts.accepted_identities(decided, ids).select("plan_id", "id_satker")


@query("appended_reviews", _SCORED + """
 SELECT CAST(id AS VARCHAR) AS reviewer_id, CASE WHEN id % 2 = 0 THEN 'CONFIRM_MATCH' ELSE
  'REJECT_MATCH' END AS human_decision, TRUE AS bound FROM d
 WHERE status = 'NEEDS_MANUAL_REVIEW' AND id % 3 <> 0""")
def appended_reviews(spark, sf_dir):
    """Verdicts on all decisions; only those with a review record and a known verdict count."""
    evidence = letter_evidence(spark, sf_dir)
    audited = linkage.cut_lineage(linkage.audit_records(linkage.resolve_identity(
        letter_plans(spark, sf_dir), evidence), evidence, "v1"))
    k = F.col("plan_id").cast("long")
    reviews = audited.select(
        "decision_id", F.when(k % 3 == 0, "MAYBE").when(k % 2 == 0, "CONFIRM_MATCH").otherwise(
            "REJECT_MATCH").alias("human_decision"),
        F.col("plan_id").alias("reviewer_id"), F.lit("now").alias("reviewed_at"))
    out = contracts.append_reviews(audited, reviews)
    return out.select("reviewer_id", "human_decision", (
        F.col("machine_evidence_digest").isNotNull() & F.col("review_decision_id").startswith(
            "human-review-")).alias("bound"))


SOURCES = ["LPSE", "SIKAP", "KATALOG"]


@query("collection_summary", f"""
 WITH e AS (SELECT {pick_sql(SOURCES, 'o_orderkey')} AS source_type,
   CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS evidence_level FROM orders)
 SELECT 'source_type' AS "column", source_type AS value, count(*) AS rows FROM e GROUP BY 2
 UNION ALL SELECT 'evidence_level', evidence_level, count(*) FROM e GROUP BY 2""")
def collection_summary(spark, sf_dir):
    """Collected evidence per source type and level."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(pick(SOURCES, k).alias("source_type"), F.when(
        k % 4 > 0, F.col("o_orderstatus")).alias("evidence_level"))
    return summaries.frequency(rows, ["source_type", "evidence_level"])


@query("product_data_set", """
 SELECT CAST(p_partkey AS VARCHAR) AS id, FALSE AS using_seed_fallback,
  (SELECT max('2026-01-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0')) FROM part)
   AS synced_at FROM part""")
def product_data_set(spark, sf_dir):
    """Stored products replace the seed; with the time of the latest sync."""
    k = F.col("p_partkey")
    stored = table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.lit("UPS").alias("category"),
        F.array(F.lower("p_name")).alias("keywords"), F.lit("SYNC").alias("source"),
        F.concat(F.lit("2026-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias(
            "synced_at"), F.lit("x").alias("evidence_status"))
    chosen = products.product_data_set(stored, products.seed_products(spark))
    latest = products.latest_sync(chosen).scalar()
    return chosen.select("id", "using_seed_fallback", latest.alias("synced_at"))


@query("source_drift", """
 SELECT 'run-' || (event_id // 100 % 5) AS run_id, min(1000 + event_id // 100 % 3) AS lowest,
  max(1000 + event_id // 100 % 3) AS highest FROM events GROUP BY 1 HAVING min(event_id // 100 % 3)
  <> max(event_id // 100 % 3)""")
def source_drift(spark, sf_dir):
    page = F.floor(F.col("event_id") / 100)
    pages = table(spark, sf_dir, "events").select(page.alias("page")).distinct().select(
        F.concat(F.lit("run-"), (F.col("page") % 5).cast("string")).alias("run_id"),
        (1000 + F.col("page") % 3).alias("source_count"))
    return runlog.source_drift(pages)


@query("run_manifest", """
 WITH h AS (SELECT event_id // 40 AS run, event_id, sha256('{"event_type":"' || event_type ||
   '","id":' || event_id || '}') AS d FROM events)
 SELECT 'run-' || run AS run_id, count(*) AS row_count, count(*) AS distinct_id_count,
  min(event_id) AS min_id, max(event_id) AS max_id,
  count(*) - CASE WHEN run % 7 = 2 THEN 1 ELSE 0 END AS page_count, sha256(count(*) || ':' ||
   sum(CAST('0x' || substr(d, 1, 8) AS BIGINT)) || ':' || sum(CAST('0x' || substr(d, 9, 8) AS
   BIGINT)) || ':' || sum(CAST('0x' || substr(d, 17, 8) AS BIGINT)) || ':' || sum(CAST('0x' ||
   substr(d, 25, 8) AS BIGINT))) AS digest FROM h GROUP BY run""")
def run_manifest(spark, sf_dir):
    """Totals of each run's receipts with the metrics and the digest of its rows."""
    facts = runlog.chain_facts(acquisition.run_logs(spark, sf_dir)).select(
        "run_id", F.col("pages").alias("page_count"))
    run = F.concat(F.lit("run-"), F.floor(F.col("event_id") / 40).cast("string"))
    rows = table(spark, sf_dir, "events").select(run.alias("run_id"), F.col("event_id").alias(
        "id"), "event_type")
    alone = spark.createDataFrame([], "run_id string, baseline_run_id string")
    stored = qualification.run_facts(qualification.key_facts(rows, alone))
    return runlog.manifest_rows(
        facts, stored.select("run_id", "row_count", "distinct_id_count", "min_id", "max_id"),
        stored.select("run_id", F.col("sha256").alias("digest")))


@query("sent_projection", _E + """
 SELECT seq, event_type = 'purchase' AND k % 3 > 0 AS completed, CASE WHEN event_type = 'purchase'
  AND k % 3 > 0 THEN 't' || seq END AS timestamp FROM e""")
def sent_projection(spark, sf_dir):
    at = F.when(F.col("k") % 3 > 0, F.concat(F.lit("t"), F.col("event_id").cast("string")))
    sent = prospects.sent_projection(F.when(F.col("event_type") == "purchase", "sent").otherwise(
        "open"), at)
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), sent.alias("s")).select(
        "seq", "s.completed", "s.timestamp")
