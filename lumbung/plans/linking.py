"""Linkage queries: plans from customers, execution evidence from suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.operators import linkage, summaries
from lumbung.plans import sqltext as S
from lumbung.plans.registry import query
from lumbung.plans.views import (AGENCIES, GOODS, METHODS, STAGES, UNITS, agencies, packages, pick,
                                 table, with_packages)
from lumbung.rules import evidence as ER

LETTERS = list("abcdefghijklmnopqrstuvwxyz")


# ---- letters: texts are equal or share nothing, so equality decides and SQL can follow ---------
def letter_plans(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("plan_id"),
        F.repeat(pick(LETTERS[:13], k), F.lit(8)).alias("package_name"),
        F.when(k % 17 == 0, "").otherwise(F.repeat(pick(LETTERS, n), F.lit(6))).alias(
            "institution"),
        F.when(k % 3 == 0, "").otherwise(F.repeat(pick(LETTERS[:5], k), F.lit(5))).alias("satker"),
        (2025 + k % 2).cast("int").alias("year"),
        F.when(k % 5 == 0, 1e9).otherwise(5e8).alias("budget"),
        pick(["Tender", "E-Purchasing", ""], k).alias("procurement_method"),
        F.lit("").alias("location"), F.lit("").alias("category"))


def letter_evidence(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    return table(spark, sf_dir, "supplier").select(
        F.format_string("e%08d", k).alias("candidate_id"),
        F.repeat(pick(LETTERS[:13], k), F.lit(8)).alias("package_name"),
        F.repeat(pick(LETTERS, n), F.lit(6)).alias("institution"),
        F.when(k % 2 == 0, "").otherwise(F.repeat(pick(LETTERS[:5], k), F.lit(5))).alias(
            "satker"),
        (2025 + k % 2).cast("int").alias("year"),
        F.when(k % 4 == 0, 1e9).otherwise(5e8).alias("budget"),
        pick(["Tender", "", "Pengadaan Langsung"], k).alias("procurement_method"),
        F.lit("").alias("location"), F.lit("").alias("category"),
        F.lit("SPSE").alias("evidence_type"), F.lit("https://x.id/e").alias("source_url"),
        F.lit("evidence.csv").alias("source_file"), F.lit("").alias("source_record_id"),
        F.lit("2026-01-01").alias("collected_at"), F.lit("").alias("provenance"),
        pick(STAGES, k).alias("source_status"), F.lit("1 M").alias("hps_or_pagu"),
        F.lit("").alias("matched_text"))


_SCORED = """
 WITH p AS (SELECT c_custkey AS id, c_custkey % 13 AS name, CASE WHEN c_custkey % 17 = 0 THEN
   NULL ELSE c_nationkey END AS inst, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 5
   END AS unit, 2025 + c_custkey % 2 AS year, CASE WHEN c_custkey % 5 = 0 THEN 1e9 ELSE 5e8 END
   AS cost, ['T', 'EP', ''][1 + CAST(c_custkey % 3 AS INTEGER)] AS way FROM customer),
 e AS (SELECT printf('e%08d', s_suppkey) AS cid, s_suppkey, s_suppkey % 13 AS name,
   s_nationkey AS inst, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey % 5 END AS unit,
   2025 + s_suppkey % 2 AS year, CASE WHEN s_suppkey % 4 = 0 THEN 1e9 ELSE 5e8 END AS cost,
   ['T', '', 'NT'][1 + CAST(s_suppkey % 3 AS INTEGER)] AS way FROM supplier),
 j AS (SELECT p.id, e.cid, e.s_suppkey, p.name = e.name AS n,
   coalesce(p.inst = e.inst, FALSE) AS i, coalesce(p.unit = e.unit, FALSE) AS u,
   p.year = e.year AS y, p.cost = e.cost AS b, p.way <> '' AND p.way = e.way AS m,
   p.inst IS NOT NULL AND p.inst <> e.inst AS hi,
   p.unit IS NOT NULL AND e.unit IS NOT NULL AND p.unit <> e.unit AS hu, p.name <> e.name AS hn,
   p.way <> '' AND e.way <> '' AND p.way <> e.way AS hm FROM p, e),
 s AS (SELECT *, hi OR hu OR hn OR hm AS dead, CAST(n AS INTEGER) + CAST(i AS INTEGER) +
   CAST(u AS INTEGER) AS prim, CAST(n AS INTEGER) + CAST(i AS INTEGER) + CAST(u AS INTEGER) +
   CAST(y AS INTEGER) + CAST(b AS INTEGER) + CAST(m AS INTEGER) AS total,
   round_even((CAST(n AS INTEGER) + CAST(i AS INTEGER) + CAST(u AS INTEGER) +
     CASE WHEN b THEN 1.0 ELSE 0.5 END) / 8, 6) AS conf FROM j),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prim DESC, total DESC, conf DESC,
   cid) AS rn, lead((prim, total, conf)) OVER (PARTITION BY id ORDER BY prim DESC, total DESC,
   conf DESC, cid) AS nxt, count(*) OVER (PARTITION BY id) AS remaining FROM s WHERE NOT dead),
 h AS (SELECT id, bool_or(hi) AS hi, bool_or(hu) AS hu, bool_or(hn) AS hn, bool_or(hm) AS hm
   FROM s GROUP BY 1),
 d AS (SELECT h.id, coalesce(remaining, 0) AS remaining, r.cid, r.conf, r.s_suppkey, CASE
   WHEN r.id IS NULL THEN CASE WHEN CAST(h.hi AS INTEGER) + CAST(h.hu AS INTEGER) +
     CAST(h.hn AS INTEGER) + CAST(h.hm AS INTEGER) <> 1 THEN 'REJECTED_IDENTITY_CONFLICT'
     WHEN h.hi THEN 'REJECTED_INSTITUTION_CONFLICT' WHEN h.hu THEN 'REJECTED_SATKER_CONFLICT'
     WHEN h.hn THEN 'REJECTED_PACKAGE_CONFLICT'
     ELSE 'REJECTED_PROCUREMENT_METHOD_CONFLICT' END
   WHEN nxt = (prim, total, conf) THEN 'NEEDS_MANUAL_REVIEW'
   WHEN n AND (i OR u) AND total >= 3 THEN 'CONFIRMED_MATCH'
   WHEN total >= 2 AND prim > 0 THEN 'PROBABLE_MATCH' WHEN total > 0 THEN 'NEEDS_MANUAL_REVIEW'
   ELSE 'NO_MATCH' END AS status FROM h LEFT JOIN r ON h.id = r.id AND rn = 1)"""
_STAGE_SQL = "['Tender Selesai', 'Evaluasi Penawaran', 'Pemenang Berkontrak', 'Tender Batal', " \
    "'Pengumuman Pascakualifikasi', 'Masa Sanggah', ''][1 + CAST(s_suppkey % 7 AS INTEGER)]"
_STATUS_SQL = f"""CASE WHEN status NOT IN ('CONFIRMED_MATCH', 'PROBABLE_MATCH')
 OR s_suppkey % 7 = 6 THEN 'SIRUP_PLANNING_ONLY' ELSE
 {S.first_class(S.normalize(_STAGE_SQL), ER.PROCUREMENT_STATUS, "'OBSERVED_OTHER'")} END"""


@query("link_equality", _SCORED + """
 SELECT CAST(id AS VARCHAR) AS plan_id, status AS identity_status, remaining,
  CASE WHEN status <> 'NO_MATCH' THEN cid END AS selected_candidate_id,
  CASE WHEN status <> 'NO_MATCH' THEN coalesce(conf, 0.0) ELSE 0.0 END AS confidence FROM d""")
def link_equality(spark, sf_dir):
    rows = linkage.resolve_identity(letter_plans(spark, sf_dir), letter_evidence(spark, sf_dir))
    return rows.select("plan_id", "identity_status", "remaining", "selected_candidate_id",
                       F.col("identity_confidence").alias("confidence"))


@query("link_equality_blocked", _SCORED + """
 SELECT status AS identity_status, count(*) AS plans, sum(remaining) AS candidates FROM d
 GROUP BY 1""")
def link_equality_blocked(spark, sf_dir):
    rows = linkage.resolve_identity(letter_plans(spark, sf_dir), letter_evidence(spark, sf_dir),
                                    tile=400)
    return rows.groupBy("identity_status").agg(F.count("*").alias("plans"),
                                               F.sum("remaining").alias("candidates"))


@query("link_status", _SCORED + f"""
 SELECT CAST(id AS VARCHAR) AS plan_id, {_STATUS_SQL} AS normalized_status FROM d""")
def link_status(spark, sf_dir):
    evidence = letter_evidence(spark, sf_dir)
    rows = linkage.resolve_identity(letter_plans(spark, sf_dir), evidence)
    return linkage.with_status(rows, evidence).select("plan_id", "normalized_status")


@query("mapping_table", _SCORED + f"""
 SELECT CAST(id AS VARCHAR) AS sirup_package_id, status AS match_level,
  CASE WHEN status IN ('CONFIRMED_MATCH', 'PROBABLE_MATCH') THEN cid ELSE '' END
    AS spse_package_code,
  CASE WHEN status IN ('CONFIRMED_MATCH', 'PROBABLE_MATCH') THEN {_STATUS_SQL}
    WHEN status = 'NEEDS_MANUAL_REVIEW' THEN status ELSE 'SIRUP_PLANNING_ONLY' END
    AS evidence_status FROM d""")
def mapping_table(spark, sf_dir):
    plans, evidence = letter_plans(spark, sf_dir), letter_evidence(spark, sf_dir)
    audited = linkage.audit_records(linkage.resolve_identity(plans, evidence), evidence, "v1")
    return linkage.mapping_table(plans, audited, evidence).select(
        "sirup_package_id", "match_level", "spse_package_code", "evidence_status")


def letter_crosscheck(spark, sf_dir):
    """Customers again as packages, so that the cross-check has its planning columns."""
    plans, evidence = letter_plans(spark, sf_dir), letter_evidence(spark, sf_dir)
    audited = linkage.audit_records(linkage.resolve_identity(plans, evidence), evidence, "v1")
    k = F.col("plan_id").cast("long")
    rows = plans.select(
        k.alias("id"), F.lit("").alias("id_referensi"), F.col("budget").alias("pagu"),
        F.col("satker").alias("satuanKerja"), F.col("institution").alias("kldi"),
        F.lit("Aceh, Banda").alias("lokasi"), F.col("procurement_method").alias("metode"),
        F.col("package_name").alias("paket"),
        F.concat_ws(" ", pick(["May", "June", "April", "Mei"], k),
                    F.col("year").cast("string")).alias("pemilihan"), F.lit(5).alias("idBulan"))
    return linkage.crosscheck_table(rows, audited, evidence, 2026)


@query("crosscheck_summary", _SCORED + f"""
 , x AS (SELECT id, {_STATUS_SQL} AS fs, status IN ('CONFIRMED_MATCH', 'PROBABLE_MATCH') AS ok,
   id % 4 AS m, 2025 + id % 2 AS y FROM d)
 SELECT count(*) AS total_rows, count(*) FILTER (ok) AS with_evidence,
  count(*) FILTER (fs = 'SIRUP_PLANNING_ONLY') AS planning_only,
  count(*) FILTER (m IN (0, 3)) AS may, count(*) FILTER (m = 1) AS june,
  count(*) FILTER (m IN (0, 1, 3)) / count(*) AS may_june_share,
  count(*) FILTER (m = 2) AS jan_apr, count(*) FILTER (y = 2025) AS mentions_2025 FROM x""")
def crosscheck_summary(spark, sf_dir):
    return summaries.crosscheck_summary(letter_crosscheck(spark, sf_dir))


@query("manual_queue", _SCORED + f"""
 , x AS (SELECT id, status, {_STATUS_SQL} AS fs FROM d)
 SELECT CAST(id AS VARCHAR) AS rup_id, status AS identity_status, fs AS factual_status FROM x
 WHERE status = 'NEEDS_MANUAL_REVIEW' OR fs = 'SIRUP_PLANNING_ONLY'""")
def manual_queue(spark, sf_dir):
    return linkage.manual_queue(letter_crosscheck(spark, sf_dir)).select(
        "rup_id", "identity_status", "factual_status")


@query("latest_status", """
 SELECT CAST(l_partkey AS VARCHAR) AS candidate_id, arg_max(l_shipmode_like,
  (ts, l_orderkey, l_suppkey, l_linenumber, l_extendedprice)) AS source_status,
  max(ts) AS observed_at FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS ts,
   CASE l_returnflag WHEN 'A' THEN 'Selesai' ELSE 'Tender' END AS l_shipmode_like
   FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1""")
def latest_status(spark, sf_dir):
    """Shipments as status observations; open ones carry none."""
    parts = [F.format_string("%012d", F.col(c).cast("long")) for c in
             ("l_orderkey", "l_suppkey", "l_linenumber")]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("candidate_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("collected_at"),
        F.concat(*parts, F.format_string("%015.2f", F.col("l_extendedprice"))).alias(
            "source_record_id"),
        F.when(F.col("l_linestatus") != "F", "").when(
            F.col("l_returnflag") == "A", "Selesai").otherwise("Tender").alias("source_status"))
    return linkage.latest_status(rows)


@query("candidate_audit", _SCORED + """
 SELECT CAST(id AS VARCHAR) AS plan_id, rn AS rank, cid AS candidate_id, prim AS primary_count,
  total AS total_count, conf AS confidence, array_to_string(list_filter([
   CASE WHEN b THEN 'BUDGET' END, CASE WHEN i THEN 'INSTITUTION' END,
   CASE WHEN n THEN 'PACKAGE_NAME' END, CASE WHEN m THEN 'PROCUREMENT_METHOD' END,
   CASE WHEN u THEN 'SATKER' END, CASE WHEN y THEN 'YEAR' END], lambda x: x IS NOT NULL), ',')
   AS signals,
  array_to_string(list_filter([CASE WHEN NOT b THEN 'BUDGET_DEVIATION:SOFT' END,
   CASE WHEN NOT y THEN 'YEAR_CONFLICT:SOFT:' || (2025 + id % 2) || ' != ' ||
     (2025 + s_suppkey % 2) END], lambda x: x IS NOT NULL), ',') AS conflicts,
  'https://x.id/e' AS evidence_reference FROM r""")
def candidate_audit(spark, sf_dir):
    """Every surviving candidate of every plan in rank order."""
    members, rows = linkage.audited_classes(letter_plans(spark, sf_dir),
                                            letter_evidence(spark, sf_dir))
    shown = F.transform("conflicts", lambda c: F.concat_ws(":", c["type"], c["severity"], F.when(
        c["type"] == "YEAR_CONFLICT", c["detail"])))
    # Texts are made once for each class, before its rows are repeated for its plans.
    return linkage.every_plan(members, rows.withColumns({
        "signals": F.array_join("signals", ","), "conflicts": F.array_join(shown, ",")}))


@query("rejected_counts", _SCORED + """
 SELECT CAST(id AS VARCHAR) AS plan_id, count(*) FILTER (hi) AS institution_conflicts,
  count(*) FILTER (hu) AS satker_conflicts, count(*) FILTER (hn) AS package_name_conflicts,
  count(*) FILTER (hm) AS method_conflicts FROM s GROUP BY 1""")
def rejected_counts(spark, sf_dir):
    return linkage.rejected_counts(letter_plans(spark, sf_dir), letter_evidence(spark, sf_dir))


# ---- stems: a common beginning and ends without a common letter, so SQL can give the ratio ------
STEM = "abcdefghijklmnop"  # all different, so the longest common block is the common beginning


def stem_text(length, tail, letter: str):
    return F.concat(F.substring(F.lit(STEM), F.lit(1), length.cast("int")),
                    F.repeat(F.lit(letter), tail.cast("int")))


def stem_plans(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("plan_id"),
        stem_text(6 + k % 11, k % 4, "x").alias("package_name"),
        F.when(k % 17 == 0, "").otherwise(stem_text(8 + k % 9, k % 3, "x")).alias("institution"),
        F.when(k % 3 == 0, "").otherwise(stem_text(7 + k % 7, k % 5, "x")).alias("satker"),
        (2025 + k % 2).cast("int").alias("year"), (1e8 * (1 + k % 7)).alias("budget"),
        pick(["Tender", "E-Purchasing", ""], k).alias("procurement_method"),
        F.lit("").alias("location"), F.lit("").alias("category"))


def stem_evidence(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.format_string("e%08d", k).alias("candidate_id"),
        stem_text(4 + k % 13, k % 3, "y").alias("package_name"),
        F.when(k % 19 == 0, "").otherwise(stem_text(5 + k % 12, k % 4, "y")).alias("institution"),
        F.when(k % 2 == 0, "").otherwise(stem_text(5 + k % 11, k % 2, "y")).alias("satker"),
        (2025 + k % 2).cast("int").alias("year"), (1e8 * (1 + k % 5)).alias("budget"),
        pick(["Tender", "", "Pengadaan Langsung"], k).alias("procurement_method"),
        F.lit("").alias("location"), F.lit("").alias("category"))


def _ratio_sql(a: str, at: str, b: str, bt: str) -> str:
    return f"2.0 * least({a}, {b}) / ({a} + {at} + {b} + {bt})"


def _rounded_sql(x: str) -> str:
    """Six digits, the nearer one of the exact binary value: compared in whole numbers."""
    low, one = f"CAST(floor(({x}) * 1000000) AS HUGEINT)", "4611686018427387904"
    exact, middle = f"CAST(({x}) * {one}.0 AS HUGEINT) * 2000000", f"(2 * {low} + 1) * {one}"
    return (f"({low} + CASE WHEN {exact} > {middle} OR ({exact} = {middle} AND {low} % 2 = 1) "
            f"THEN 1 ELSE 0 END) / 1000000.0")


_STEMS = f"""
 WITH p AS (SELECT c_custkey AS id, 6 + c_custkey % 11 AS nl, c_custkey % 4 AS nt,
   CASE WHEN c_custkey % 17 <> 0 THEN 8 + c_custkey % 9 END AS il, c_custkey % 3 AS it,
   CASE WHEN c_custkey % 3 <> 0 THEN 7 + c_custkey % 7 END AS ul, c_custkey % 5 AS ut,
   2025 + c_custkey % 2 AS year, 1e8 * (1 + c_custkey % 7) AS cost,
   ['T', 'EP', ''][1 + CAST(c_custkey % 3 AS INTEGER)] AS way FROM customer),
 e AS (SELECT printf('e%08d', s_suppkey) AS cid, 4 + s_suppkey % 13 AS nl, s_suppkey % 3 AS nt,
   CASE WHEN s_suppkey % 19 <> 0 THEN 5 + s_suppkey % 12 END AS il, s_suppkey % 4 AS it,
   CASE WHEN s_suppkey % 2 <> 0 THEN 5 + s_suppkey % 11 END AS ul, s_suppkey % 2 AS ut,
   2025 + s_suppkey % 2 AS year, 1e8 * (1 + s_suppkey % 5) AS cost,
   ['T', '', 'NT'][1 + CAST(s_suppkey % 3 AS INTEGER)] AS way FROM supplier),
 j AS (SELECT p.id, e.cid, {_ratio_sql('p.nl', 'p.nt', 'e.nl', 'e.nt')} AS rn,
   {_ratio_sql('p.il', 'p.it', 'e.il', 'e.it')} AS ri,
   {_ratio_sql('p.ul', 'p.ut', 'e.ul', 'e.ut')} AS ru, p.year = e.year AS y,
   1.0 - abs(p.cost - e.cost) / greatest(p.cost, e.cost) AS rb,
   p.way <> '' AND p.way = e.way AS m, p.way <> '' AND e.way <> '' AND p.way <> e.way AS hm
   FROM p, e),
 s AS (SELECT *, coalesce(ri < 0.65, FALSE) AS hi, coalesce(ru < 0.65, FALSE) AS hu, rn < 0.45
   AS hn, rn >= 0.8 AS n, coalesce(ri >= 0.8, FALSE) AS i, coalesce(ru >= 0.8, FALSE) AS u,
   rb >= 0.85 AS b,
   {_rounded_sql('(rn + coalesce(ri, 0.0) + coalesce(ru, 0.0) + rb) / 8')} AS conf FROM j),
 t AS (SELECT *, hi OR hu OR hn OR hm AS dead, CAST(n AS INTEGER) + CAST(i AS INTEGER) +
   CAST(u AS INTEGER) AS prim, CAST(n AS INTEGER) + CAST(i AS INTEGER) + CAST(u AS INTEGER) +
   CAST(y AS INTEGER) + CAST(b AS INTEGER) + CAST(m AS INTEGER) AS total FROM s),
 r AS (SELECT *, row_number() OVER w AS k, lead((prim, total, conf)) OVER w AS nxt,
   count(*) OVER (PARTITION BY id) AS remaining FROM t WHERE NOT dead
   WINDOW w AS (PARTITION BY id ORDER BY prim DESC, total DESC, conf DESC, cid)),
 h AS (SELECT id, bool_or(hi) AS hi, bool_or(hu) AS hu, bool_or(hn) AS hn, bool_or(hm) AS hm
   FROM t GROUP BY 1),
 d AS (SELECT h.id, coalesce(remaining, 0) AS remaining, r.cid, r.conf, CASE
   WHEN r.id IS NULL THEN CASE WHEN CAST(h.hi AS INTEGER) + CAST(h.hu AS INTEGER) +
     CAST(h.hn AS INTEGER) + CAST(h.hm AS INTEGER) <> 1 THEN 'REJECTED_IDENTITY_CONFLICT'
     WHEN h.hi THEN 'REJECTED_INSTITUTION_CONFLICT' WHEN h.hu THEN 'REJECTED_SATKER_CONFLICT'
     WHEN h.hn THEN 'REJECTED_PACKAGE_CONFLICT'
     ELSE 'REJECTED_PROCUREMENT_METHOD_CONFLICT' END
   WHEN nxt = (prim, total, conf) THEN 'NEEDS_MANUAL_REVIEW'
   WHEN n AND (i OR u) AND total >= 3 THEN 'CONFIRMED_MATCH'
   WHEN total >= 2 AND prim > 0 THEN 'PROBABLE_MATCH' WHEN total > 0 THEN 'NEEDS_MANUAL_REVIEW'
   ELSE 'NO_MATCH' END AS status FROM h LEFT JOIN r ON h.id = r.id AND k = 1)"""


@query("link_fuzzy", _STEMS + """
 SELECT CAST(id AS VARCHAR) AS plan_id, status AS identity_status, remaining,
  CASE WHEN status <> 'NO_MATCH' THEN cid END AS selected_candidate_id,
  CASE WHEN status <> 'NO_MATCH' THEN coalesce(conf, 0.0) ELSE 0.0 END AS identity_confidence
 FROM d""")
def link_fuzzy(spark, sf_dir):
    """Similarities fall on both sides of every threshold."""
    return linkage.resolve_identity(stem_plans(spark, sf_dir), stem_evidence(spark, sf_dir)
                                    ).select("plan_id", "identity_status", "remaining",
                                             "selected_candidate_id", "identity_confidence")


@query("link_fuzzy_blocked", _STEMS + """
 SELECT status AS identity_status, count(*) AS plans, sum(remaining)::BIGINT AS candidates FROM d
 GROUP BY 1""")
def link_fuzzy_blocked(spark, sf_dir):
    """The same in small tiles."""
    rows = linkage.resolve_identity(stem_plans(spark, sf_dir), stem_evidence(spark, sf_dir),
                                    tile=300)
    return rows.groupBy("identity_status").agg(F.count("*").alias("plans"),
                                               F.sum("remaining").alias("candidates"))


@query("similar_part_names", """
 WITH t AS (SELECT DISTINCT 3 + p_partkey % 14 AS l, p_partkey % 5 AS t FROM part),
 n AS (SELECT l, t, substr('abcdefghijklmnop', 1, CAST(l AS INTEGER)) || repeat('x',
   CAST(t AS INTEGER)) AS name FROM t)
 SELECT a.name AS left_text, b.name AS right_text FROM n a JOIN n b ON a.name < b.name
  AND 2.0 * (least(a.l, b.l) + least(a.t, b.t)) / (a.l + a.t + b.l + b.t) >= 0.8""")
def similar_part_names(spark, sf_dir):
    """Distinct part labels at least 0.8 similar, each unordered pair once."""
    k = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(stem_text(3 + k % 14, k % 5, "x").alias("text"))
    return linkage.similar_values(names, names, 0.8).where("left_text < right_text")


@query("similar_part_texts")
def similar_part_texts(spark, sf_dir):
    """The same over the names as published; checked against all pairs by a test."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    return linkage.similar_values(names, names, 0.8).where("left_text < right_text")


# ---- words: names as published (the same decisions are checked by tests on small fixtures) ------
def word_plans(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(
        agencies(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.cast("string").alias("plan_id"),
        F.concat_ws(" ", F.lit("Pengadaan"), pick(GOODS, k), pick(UNITS, k)).alias(
            "package_name"),
        F.concat_ws(" ", pick(AGENCIES, k), "r_name", "n_name").alias("institution"),
        pick(UNITS, k).alias("satker"), (2025 + k % 2).cast("int").alias("year"),
        (F.col("c_acctbal") * 1e6).alias("budget"), pick(METHODS, k).alias(
            "procurement_method"), F.col("r_name").alias("location"),
        F.col("c_mktsegment").alias("category"))


def word_evidence(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(
        agencies(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("spse-"), k.cast("string")).alias("candidate_id"),
        F.concat_ws(" ", F.lit("Belanja"), pick(GOODS, k * 3), pick(UNITS, k)).alias(
            "package_name"),
        F.concat_ws(" ", pick(AGENCIES, k), "r_name", "n_name").alias("institution"),
        pick(UNITS, k * 5).alias("satker"), (2025 + k % 2).cast("int").alias("year"),
        (F.col("s_acctbal") * 1e6).alias("budget"), pick(METHODS, k).alias(
            "procurement_method"), F.col("r_name").alias("location"),
        F.lit("").alias("category"))


@query("link_words")
def link_words(spark, sf_dir):
    return linkage.resolve_identity(word_plans(spark, sf_dir), word_evidence(spark, sf_dir)
                                    ).select("plan_id", "identity_status",
                                             "selected_candidate_id", "identity_confidence")


@query("plan_records", with_packages("""
 SELECT CAST(id AS VARCHAR) AS plan_id, kldi AS institution, "satuanKerja" AS satker,
  CASE WHEN pemilihan LIKE '%20__' THEN CAST(substr(pemilihan, -4) AS INTEGER) END AS year
 FROM packages"""))
def plan_records(spark, sf_dir):
    return linkage.plan_records(packages(spark, sf_dir)).select(
        "plan_id", "institution", "satker", "year")
