"""Queries over stored pages and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.functions import text as X
from lumbung.operators import registry, status
from lumbung.plans import sqltext as S
from lumbung.plans.registry import query
from lumbung.plans.views import pick, pick_sql, table
from lumbung.rules import evidence as ER
from lumbung.sources import evidence as ev
from lumbung.sources import html


@query("page_anchors", """
 SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages""")
def page_anchors(spark, sf_dir):
    return html.html_anchors(table(spark, sf_dir, "pages")).select("page_id", "href")


SECTIONS = {"the": ["the", "th"], "que": ["que", "qu"], "rest": ["e", "a"]}


@query("page_links", """
 WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1))
   AS href FROM pages),
 s AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS absolute,
   CASE WHEN contains(lower(href), 'th') THEN 'the' WHEN contains(lower(href), 'qu') THEN 'que'
   WHEN contains(lower(href), 'e') OR contains(lower(href), 'a') THEN 'rest' END AS section
   FROM a)
 SELECT DISTINCT page_id, section, absolute FROM s WHERE section IS NOT NULL""")
def page_links(spark, sf_dir):
    anchors = html.html_anchors(table(spark, sf_dir, "pages"))
    return html.page_links(anchors, SECTIONS).select("page_id", "section", "absolute")


@query("strip_html", """
 SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(
  regexp_replace(html, '\\s+', ' ', 'g')), '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
 FROM pages""")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias(
        "text"))


def order_tables(spark, sf_dir):
    """One detail page per order: an outer label table with the shipments as a nested table."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))  # an order is small
    rows = F.array_join(F.transform("items", lambda i: F.concat(
        F.lit("<tr><td>"), i["l_partkey"].cast("string"), F.lit("</td><td>name "),
        i["l_suppkey"].cast("string"), F.lit("</td></tr>"))), "")
    page = F.concat(
        F.lit("<html><table><tr><th>Info</th></tr><tr><td>Kode Tender</td><td>"),
        F.col("o_orderkey").cast("string"), F.lit("</td></tr><tr><td>Nama Paket</td><td><b>"),
        "o_orderpriority", F.lit("</b></td><td>Satuan Kerja</td><td>S"),
        F.col("o_custkey").cast("string"), F.lit("</td></tr><tr><td>Nama Paket</td><td>later"
                                                 "</td></tr><tr><td><table><tr><th>Kode RUP</th>"
                                                 "<th>Nama Paket</th></tr>"), rows,
        F.lit("</table></td></tr></table></html>"))
    return items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col(
        "o_orderkey")).select(F.col("o_orderkey").alias("page_id"), page.alias("html"))


@query("html_tables", """
 SELECT l_orderkey AS page_id, 0 AS table_idx, count(*) AS rows, string_agg(
   l_partkey || '|name ' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
 UNION ALL
 SELECT o_orderkey, 1, 3, 'Kode Tender|' || o_orderkey || '||;Nama Paket|' || o_orderpriority ||
   '|Satuan Kerja|S' || o_custkey || ';Nama Paket|later||'
 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def html_tables(spark, sf_dir):
    """Every cell of both tables of each page."""
    cells = F.transform("rows", lambda r: F.array_join(r, "|", ""))
    return html.page_tables(html.parsed_pages(order_tables(spark, sf_dir))).select(
        "page_id", "table_idx", F.greatest(F.size("rows"), F.lit(1)).cast("long").alias("rows"),
        F.array_join(cells, ";").alias("cells"))


@query("detail_fields", """
 SELECT o_orderkey AS page_id, CAST(o_orderkey AS VARCHAR) AS package_code,
  o_orderpriority AS package_name, 'S' || o_custkey AS satker, coalesce(code, '') AS kode_rup, n
  AS rup_rows FROM orders JOIN (SELECT l_orderkey, count(*) AS n,
   CASE WHEN count(DISTINCT l_partkey) = 1 THEN CAST(min(l_partkey) AS VARCHAR) ELSE '' END
   AS code FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def detail_fields(spark, sf_dir):
    return html.page_details(html.parsed_pages(order_tables(spark, sf_dir))).select(
        "page_id", "package_code", "package_name", "satker", "kode_rup",
        F.size("kode_rup_rows").alias("rup_rows"))


@query("table_snippets", """
 WITH l AS (SELECT l_orderkey, l_partkey || ' | name ' || l_suppkey AS line, row_number() OVER (
   PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem
   JOIN orders ON l_orderkey = o_orderkey)
 SELECT l_orderkey AS page_id, string_agg(line, ' || ' ORDER BY rn) AS snippet FROM l
 WHERE rn <= 3 GROUP BY 1""")
def table_snippets(spark, sf_dir):
    return html.page_snippets(html.parsed_pages(order_tables(spark, sf_dir)))


def list_payloads(spark, sf_dir):
    """Orders as list payloads of 20 items, every third payload an emergency listing."""
    k = F.col("o_orderkey")
    cells = F.array(k.cast("string"), F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b>")),
                    F.concat(F.lit("I"), F.col("o_custkey").cast("string")),
                    F.lit("three"), F.lit("2026"), F.lit("five"), F.lit("six"))
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 20).alias("page"), k, cells.alias(
        "cells"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(
        "o_orderkey", "cells"))).alias("items"))  # twenty items per payload
    data = F.to_json(F.struct(F.transform("items", lambda i: i["cells"]).alias("data")))
    return pages.select(data.alias("payload"), F.when(
        F.col("page") % 3 == 0, ER.EMERGENCY_SOURCE).otherwise("tender").alias("source_type"),
        F.lit("https://x.id").alias("source_url"))


@query("payload_rows", """
 SELECT CAST(o_orderkey AS VARCHAR) AS package_code, o_orderpriority AS package_name,
  'I' || o_custkey AS institution_name, CASE WHEN o_orderkey // 20 % 3 = 0 THEN 'six'
  ELSE 'three' END AS stage_or_status, CASE WHEN o_orderkey // 20 % 3 = 0 THEN 'three'
  ELSE '2026' END AS hps_or_pagu, CASE WHEN o_orderkey // 20 % 3 = 0 THEN '2026' ELSE '2025' END
  AS fiscal_year FROM orders""")
def payload_rows(spark, sf_dir):
    return ev.payload_rows(list_payloads(spark, sf_dir), 2025).select(
        "package_code", "package_name", "institution_name", "stage_or_status", "hps_or_pagu",
        "fiscal_year")


@query("table_evidence", """
 SELECT CAST(l_partkey AS VARCHAR) AS package_code, 'name ' || l_suppkey AS package_name,
  count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def table_evidence(spark, sf_dir):
    nested = html.page_tables(html.parsed_pages(order_tables(spark, sf_dir))).where(
        "table_idx = 0")
    return ev.table_evidence(nested).groupBy("package_code", "package_name").agg(
        F.count("*").alias("rows"))


STAGE_WORDS = ["Tender Selesai", "Katalog", "nothing", "Pemenang", "spse kontrak"]


@query("generic_evidence", f"""
 WITH t AS (SELECT o_orderkey AS id, {pick_sql(STAGE_WORDS, 'o_orderkey')} AS st,
   o_totalprice FROM orders)
 SELECT CAST(id AS VARCHAR) AS rup_id, o_totalprice AS budget_value,
  {S.first_class('lower(st)', ER.FACTUAL_STATUS, 'NULL')} AS factual_status,
  CASE WHEN st = 'spse kontrak' THEN 'SPSE_LOCAL_EXPORT' WHEN st = 'Katalog' THEN
   'E_PURCHASING_OR_KATALOG_LOCAL_EXPORT' ELSE 'PROCUREMENT_STATUS_LOCAL_EXPORT' END
   AS source_type FROM t WHERE st <> 'nothing'""")
def generic_evidence(spark, sf_dir):
    """Orders under unknown headers: roles are found by synonym, rows by status words."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Kode_RUP"),
        pick(STAGE_WORDS, F.col("o_orderkey")).alias("Tahapan Saat Ini"),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("Nilai Pagu"))
    return ev.evidence_from_table(rows, "data.csv", F.col("Kode_RUP")).select(
        "rup_id", "budget_value", "factual_status", "source_type")


@query("target_keywords", f"""
 WITH d AS (SELECT p_partkey, lower(p_name || ' ' || {pick_sql(
     ['Komputer Server', 'alat laptop', 'none'], 'p_partkey')}) AS t FROM part),
 h AS (SELECT p_partkey, {S.labels_where({k: f"contains(t, '{k}')" for k in
                                          ER.TARGET_KEYWORDS})} AS hits FROM d)
 SELECT p_partkey, hits[1] AS keyword, array_to_string(hits, ';') AS matched_keywords FROM h
 WHERE len(hits) > 0""")
def target_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", pick(
        ["Komputer Server", "alat laptop", "none"], F.col("p_partkey"))).alias("package_name"))
    return status.tag_target_keywords(rows, ["package_name"]).select(
        "p_partkey", "keyword", "matched_keywords")


# ---- registry rows -----------------------------------------------------------------------------
def registry_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat_ws(" ", F.lit("LPSE"), pick(["Kabupaten", "Kota", "Provinsi"], k),
                       pick(["Riau", "Aceh", "Acme"], k))
    url = F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("https://spse.inaproc.id/p"), (k % 50).cast("string")))
    return table(spark, sf_dir, "supplier").select(
        k.alias("position"), name.alias("nama_lpse"),
        registry.category(name).alias("kategori_instansi"),
        F.when(k % 4 == 0, "Bali").otherwise(registry.province(name)).alias("provinsi"),
        url.alias("official_lpse_url"), F.when(url.isNotNull(), "spse.inaproc.id").alias("domain"),
        F.when(k % 6 != 0, k % 2 == 0).alias("https"),
        F.when(k % 7 != 0, k % 3 != 0).alias("aktif"), F.when(
            k % 5 != 0, k % 2 == 0).alias("dapat_diakses"),
        F.lit(True).alias("menggunakan_spse"), F.when(k % 3 == 0, "v4.5").alias("versi_spse"),
        F.concat(F.lit("page-"), (k % 60).cast("string")).alias("source_page"))


_REG = """
 WITH r AS (SELECT s_suppkey AS k, 'LPSE ' || ['Kabupaten', 'Kota', 'Provinsi'][1 + CAST(
   s_suppkey % 3 AS INTEGER)] || ' ' || ['Riau', 'Aceh', 'Acme'][1 + CAST(s_suppkey % 3 AS
   INTEGER)] AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'Bali' WHEN s_suppkey % 3 = 0 THEN 'Riau'
   WHEN s_suppkey % 3 = 1 THEN 'Aceh' END AS prov, s_suppkey % 6 = 0 AS no_url,
   CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 <> 0 END AS act,
   CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS acc FROM supplier)"""


@query("registry_summary", _REG + """
 SELECT count(*) AS total, count(*) FILTER (act) AS active, count(*) FILTER (NOT act)
  AS inactive, count(*) FILTER (k % 6 <> 0 AND k % 2 = 0) AS https,
  count(*) FILTER (k % 6 <> 0 AND k % 2 <> 0) AS http, count(*) FILTER (acc) AS accessible,
  count(*) FILTER (NOT acc) AS inaccessible, 'v4.5' AS versions FROM r""")
def registry_summary(spark, sf_dir):
    return registry.summary(registry_rows(spark, sf_dir))


@query("registry_by_province", _REG + """
 SELECT coalesce(prov, 'null') AS provinsi, count(*) AS rows FROM r GROUP BY 1""")
def registry_by_province(spark, sf_dir):
    return registry.counts_by(registry_rows(spark, sf_dir), "provinsi")


@query("registry_quality", _REG + """
 , f AS (SELECT *, coalesce(k % 3 <> 2 AND CASE k % 3 WHEN 0 THEN 'Riau' ELSE 'Aceh' END <> prov,
   FALSE) AS mismatch, k % 3 <> 0 AS no_version, NOT coalesce(act, FALSE) OR
   NOT coalesce(acc, FALSE) AS down FROM r)
 SELECT count(*) AS total_rows, count(*) FILTER (mismatch OR no_url OR no_version OR down)
   AS flagged_rows, count(*) FILTER (mismatch) AS province_mismatch_suspected,
  count(*) FILTER (no_url) AS missing_official_url, count(*) FILTER (no_url) AS missing_domain,
  count(*) FILTER (no_version) AS missing_spse_version,
  count(*) FILTER (down) AS inactive_or_inaccessible FROM f""")
def registry_quality(spark, sf_dir):
    return registry.quality_counts(registry.quality_flags(registry_rows(spark, sf_dir)))


@query("registry_dedup", _REG + """
 SELECT min(k) AS position, name AS nama_lpse, prov AS provinsi FROM r
 GROUP BY k % 60, name, prov""")
def registry_dedup(spark, sf_dir):
    return registry.distinct_rows(registry_rows(spark, sf_dir), "position").select(
        "position", "nama_lpse", "provinsi")


@query("portal_selection", _REG + """
 SELECT name AS nama_lpse, 'https://spse.inaproc.id/p' || (k % 50) AS base_lpse_url,
  min(k) AS position FROM r WHERE coalesce(acc, FALSE) AND NOT no_url GROUP BY 1, 2""")
def portal_selection(spark, sf_dir):
    return registry.selectable_portals(registry_rows(spark, sf_dir), "position").select(
        "nama_lpse", "base_lpse_url", "position")


@query("source_round_robin", """
 WITH n AS (SELECT count(DISTINCT source) AS s FROM documents),
 r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
       FROM documents)
 SELECT doc_id, source FROM r, n WHERE rn <= ceil(100 / s) ORDER BY doc_id LIMIT 100""")
def source_round_robin(spark, sf_dir):
    from lumbung.operators.ranking import per_source_limit

    return per_source_limit(table(spark, sf_dir, "documents"), "source", "doc_id", 100).select(
        "doc_id", "source")
