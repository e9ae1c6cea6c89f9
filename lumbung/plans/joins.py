"""Queries over contact, routing, product and contract joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.functions import text as X
from lumbung.operators import (authority, contracts, filters, leads, products, prospects,
                               routing, status, summaries, taxonomy)
from lumbung.plans import sqltext as S
from lumbung.plans.planning import (COHORT_CTE, RELEVANT_CTE, ROLLUP_CTE, TAXONOMY_CTE,
                                    plan_candidates, rollup)
from lumbung.plans.registry import query
from lumbung.plans.views import (UNITS, agencies, agencies_cte, packages, pick, pick_sql,
                                 table, with_packages)
from lumbung.rules import outreach as OR


# ---- best-scored contact lookup --------------------------------------------------------------
def loose_contacts(spark, sf_dir):
    """Two contact rows per supplier, named after a unit of some customer of the same number."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").join(
        agencies(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    unit = F.concat(pick(UNITS, key), F.lit(" Customer#"), F.lpad(key.cast("string"), 9, "0"))
    rows = base.select(key.alias("k"), unit.alias("unit"), "kldi", F.explode(
        F.array(F.lit(0), F.lit(1))).alias("copy"))
    return rows.select(
        F.col("unit").alias("institution_name"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.col("kldi")).alias("kldi"),
        F.when(F.col("copy") == 1, F.concat(F.lit("a"), F.col("k").cast("string"),
                                            F.lit("@x.id"))).otherwise("").alias("email"),
        F.when(F.col("k") % 2 == 0, "021").otherwise("").alias("phone"),
        *[F.lit("").alias(c) for c in ("whatsapp", "website", "pic_name", "pic_role", "address",
                                       "source_url")],
        F.lit("contacts.csv").alias("source_file"), F.lit("0.5").alias("confidence"),
        (F.col("k") * 2 + F.col("copy")).alias("position"))


@query("priority_key_join", with_packages(f"""
 SELECT id, coalesce(email, '') AS email, coalesce(phone, '') AS phone FROM packages LEFT JOIN (
   SELECT {pick_sql(UNITS, 's_suppkey')} || ' Customer#' ||
     lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS unit, 'a' || s_suppkey || '@x.id' AS email,
     CASE WHEN s_suppkey % 2 = 0 THEN '021' ELSE '' END AS phone FROM supplier)
 ON unit = "satuanKerja" """))
def priority_key_join(spark, sf_dir):
    index = authority.best_contact_index(loose_contacts(spark, sf_dir), "position")
    return authority.with_best_contact(packages(spark, sf_dir), index).select(
        "id", "email", "phone")


@query("leads_with_contacts", with_packages(f"""
 SELECT CASE WHEN c.unit IS NULL THEN 'Missing direct contact' WHEN has_phone THEN
   'Email + phone/WhatsApp available' ELSE 'Email available' END AS contact_readiness,
   count(*) AS rows, sum(pagu) AS pagu FROM packages LEFT JOIN (
     SELECT {pick_sql(UNITS, 's_suppkey')} || ' Customer#' ||
       lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS unit, s_suppkey % 2 = 0 AS has_phone
     FROM supplier) c ON c.unit = "satuanKerja"
 GROUP BY 1"""))
def leads_with_contacts(spark, sf_dir):
    index = authority.best_contact_index(loose_contacts(spark, sf_dir), "position")
    rows = leads.build_leads(authority.with_best_contact(packages(spark, sf_dir), index), 2026)
    return rows.groupBy("contact_readiness").agg(
        F.count("*").alias("rows"), summaries.total("budget_value").alias("pagu"))


# ---- fail-closed authority join --------------------------------------------------------------
def canonical_contacts(spark, sf_dir):
    """Contacts named after unit types: many share a name, authorities differ by agency/region."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").join(
        agencies(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    name = pick(UNITS, key)
    rows = base.select(
        F.lit("verified_cache_contacts_1640.csv").alias("source_file"),
        F.lit("verified_cache").alias("source_type"), F.lit(4).alias("source_priority"),
        F.lit(0.5).alias("source_confidence"), key.cast("int").alias("source_row"),
        name.alias("institution_name"),
        F.when(key % 5 == 0, "").otherwise(F.col("kldi")).alias("parent_organization"),
        name.alias("work_unit"),
        F.when(key % 4 == 0, "").otherwise(F.col("r_name")).alias("region"),
        F.concat(F.lit("c"), key.cast("string"), F.lit("@x.id")).alias("contact_email"),
        F.lit("").alias("official_website"),
        *[F.lit("").alias(c) for c in ("contact_phone", "contact_whatsapp", "contact_person",
                                       "contact_role", "contact_notes")],
        F.when(key % 3 == 0, "").otherwise(F.lit("https://x.id/c")).alias("contact_source_url"),
        F.lit("verified_cache").alias("contact_source_type"),
        name.alias("endpoint_organization"), F.lit(True).alias("endpoint_binding_explicit"),
        (key % 7).cast("double").alias("completeness_score"))
    rows = rows.withColumn("institution_display_name", X.display_name(
        F.col("work_unit"), F.col("parent_organization")))
    return rows.withColumn("match_keys", authority.match_keys())


def outreach_targets(spark, sf_dir):
    """One target per customer; some lack the agency, some the region."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").join(
        agencies(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    name = pick(UNITS, key)
    parent = F.when(key % 6 == 0, "").otherwise(F.col("kldi"))
    rows = base.select(
        key, name.alias("institution_name"), name.alias("work_unit"),
        parent.alias("parent_organization"),
        F.when(key % 4 == 0, "").otherwise(F.col("r_name")).alias("province_or_region"),
        F.lit("").alias("location_hint"))
    return rows.withColumn("institution_display_name", X.display_name(
        F.col("work_unit"), F.col("parent_organization")))


_AUTH = f"""
 WITH {agencies_cte()},
 c AS (SELECT s_suppkey AS k, lower(name) AS name, {S.normalize('parent')} AS p,
   {S.normalize('region')} AS r, s_suppkey % 7 AS score, url FROM (
   SELECT s_suppkey, {pick_sql(UNITS, 's_suppkey')} AS name,
    CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE kldi END AS parent,
    CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE r_name END AS region,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://x.id/c' END AS url
   FROM supplier JOIN agencies ON s_nationkey = n_nationkey)),
 ck AS (SELECT DISTINCT k, p, r, score, url, unnest([trim(name || ' ' || p),
   CASE WHEN p <> '' THEN name || ' || ' || p ELSE '' END,
   CASE WHEN r <> '' THEN name || ' || ' || r ELSE '' END, name]) AS key FROM c),
 t AS (SELECT c_custkey AS id, lower(name) AS name, {S.normalize('parent')} AS tp,
   {S.normalize('region')} AS tr FROM (
   SELECT c_custkey, {pick_sql(UNITS, 'c_custkey')} AS name,
    CASE WHEN c_custkey % 6 = 0 THEN '' ELSE kldi END AS parent,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE r_name END AS region
   FROM customer JOIN agencies ON c_nationkey = n_nationkey)),
 tk AS (SELECT id, name, tp, tr, 0 AS rank, trim(name || ' ' || tp) AS key FROM t
   UNION ALL SELECT id, name, tp, tr, 1, name || ' || ' || tp FROM t WHERE tp <> ''
   UNION ALL SELECT id, name, tp, tr, 2, name || ' || ' || tr FROM t WHERE tr <> ''),
 m AS (SELECT tk.id, tk.rank, ck.* FROM tk JOIN ck USING (key)
   WHERE (p = '' OR tp = '' OR p = tp) AND (r = '' OR tr = '' OR r = tr)
     AND ((p <> '' AND p = tp) OR (r <> '' AND r = tr))),
 g AS (SELECT id, rank, arg_max(k, score * 1000000 - k) AS best,
   arg_max(url, score * 1000000 - k) AS url, count(DISTINCT p || '#' || r) AS authorities
   FROM m GROUP BY 1, 2),
 b AS (SELECT id, min(rank) AS rank, arg_min(best, rank) AS best, arg_min(url, rank) AS url
   FROM g WHERE authorities = 1 GROUP BY 1),
 out AS (SELECT t.id, CASE rank WHEN 0 THEN 'exact_display_name' WHEN 1 THEN
   'work_unit_parent_organization' WHEN 2 THEN 'institution_name_region' ELSE 'unmatched' END
    AS contact_match_type, coalesce('c' || best || '@x.id', '') AS contact_email,
   CASE WHEN best IS NULL THEN 'CONTACT_MISSING' WHEN url <> '' THEN 'CONTACT_FOUND' ELSE
    'CONTACT_NEEDS_REVIEW' END AS contact_status FROM t LEFT JOIN b ON t.id = b.id)"""


def enriched(spark, sf_dir):
    index = authority.authority_index(canonical_contacts(spark, sf_dir))
    return authority.enrich_outreach(outreach_targets(spark, sf_dir), index, "c_custkey")


@query("authority_join", _AUTH + """
 SELECT id, contact_match_type, contact_email, contact_status,
  CASE contact_status WHEN 'CONTACT_FOUND' THEN 'DIRECT_INSTITUTION' ELSE 'UNRESOLVED' END
   AS contact_scope, contact_status = 'CONTACT_FOUND' AS direct_outreach_eligible FROM out""")
def authority_join(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        F.col("c_custkey").alias("id"), "contact_match_type", "contact_email", "contact_status",
        "contact_scope", "direct_outreach_eligible")


@query("contact_match_counts", _AUTH + """
 SELECT count(*) AS rows, count(*) FILTER (contact_match_type <> 'unmatched') AS matched,
  count(*) FILTER (contact_match_type IN ('exact_display_name',
   'work_unit_parent_organization')) AS exact,
  count(*) FILTER (contact_match_type = 'institution_name_region') AS other,
  count(*) FILTER (contact_match_type = 'unmatched') AS unmatched FROM out""")
def contact_match_counts(spark, sf_dir):
    return summaries.contact_match_counts(enriched(spark, sf_dir))


# ---- routing ---------------------------------------------------------------------------------
def agency_evidence(spark, sf_dir):
    """One agency per customer number block, named after nations."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(
        agencies(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(pick(["Kab.", "Kota", "Kabupaten"], key), F.lit(" "), "n_name", F.lit(" "),
                    (key % 40).cast("string"))
    return rows.select(
        F.concat(F.lit("D"), key.cast("string")).alias("canonical_kldi_id"),
        name.alias("source_kldi_name"), F.lit("run-1").alias("acquisition_run_id"),
        F.lit("receipt-chain:run-1").alias("receipt_chain_reference"),
        F.lit("ab").alias("receipt_chain_hash"),
        F.when(key % 31 == 0, "").otherwise("v1").alias("source_version"),
        F.col("r_name").alias("province"), F.lit("Kabupaten").alias("government_level"))


def registry_evidence(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(
        agencies(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat(F.lit("LPSE  "), pick(["kabupaten", "KOTA"], key), F.lit(" "), "n_name",
                 F.lit(" "), (key % 40).cast("string")).alias("lpse_name"),
        F.concat(F.lit("https://spse.inaproc.id/p"), F.floor(key / F.when(
            key % 10 < 2, 2).otherwise(1)).cast("string"), F.when(key % 10 < 2, "x").otherwise(
            "")).alias("official_lpse_url"),
        F.lit("registry:csv").alias("registry_artifact_id"), F.lit("cd").alias(
            "registry_artifact_hash"), F.lit("sha256:cd").alias("registry_version"),
        F.when(key % 9 == 0, "ELSEWHERE").otherwise(F.lower("r_name")).alias("province"),
        F.when(key % 8 == 0, "").otherwise("Pemerintah Kabupaten").alias("government_level"))


_ROUTES = f"""
 WITH {agencies_cte()},
 a AS (SELECT 'D' || c_custkey AS kldi_id, lower(['Kabupaten', 'Kota', 'Kabupaten'][1 +
   CAST(c_custkey % 3 AS INTEGER)] || ' ' || n_name || ' ' || (c_custkey % 40)) AS name,
   c_custkey % 31 = 0 AS no_version, r_name FROM customer
   JOIN agencies ON c_nationkey = n_nationkey),
 p AS (SELECT lower(['kabupaten', 'KOTA'][1 + CAST(s_suppkey % 2 AS INTEGER)] || ' ' || n_name
   || ' ' || (s_suppkey % 40)) AS name, CASE WHEN s_suppkey % 10 < 2 THEN
   'https://spse.inaproc.id/p' || (s_suppkey // 2) || 'x' ELSE 'https://spse.inaproc.id/p' ||
   s_suppkey END AS url, CASE WHEN s_suppkey % 9 = 0 THEN 'ELSEWHERE' ELSE r_name END AS prov
   FROM supplier JOIN agencies ON s_nationkey = n_nationkey),
 u AS (SELECT p.*, count(*) OVER (PARTITION BY url) AS url_rows,
   count(*) OVER (PARTITION BY name) AS n FROM p),
 i AS (SELECT name, any_value(url) AS url, any_value(prov) AS prov, max(url_rows) AS url_rows,
   max(n) AS n FROM u GROUP BY 1),
 j AS (SELECT kldi_id, coalesce(n, 0) AS candidate_count, CASE WHEN n = 1 THEN url ELSE '' END
   AS url, list_sort(list_filter([
   CASE WHEN no_version THEN 'MISSING_SIRUP_SOURCE_VERSION' END,
   CASE WHEN n > 1 THEN 'NORMALIZED_CANDIDATE_COUNT_NOT_ONE' END,
   CASE WHEN n IS NULL THEN 'NO_EXACT_NORMALIZED_CANDIDATE' END,
   CASE WHEN n = 1 AND url_rows > 1 THEN 'LPSE_URL_NOT_UNIQUE' END,
   CASE WHEN n = 1 AND lower(prov) <> lower(r_name) THEN 'PROVINCE_CONFLICT' END],
   lambda x: x IS NOT NULL)) AS reasons FROM a LEFT JOIN i USING (name)),
 routes AS (SELECT kldi_id, candidate_count, url, array_to_string(reasons, ';') AS reasons,
   CASE WHEN candidate_count > 1 THEN 'ROUTING_AMBIGUOUS' WHEN candidate_count = 1 AND
   len(reasons) = 0 THEN 'ROUTING_ACTIVE' ELSE 'ROUTING_REJECTED' END AS status FROM j)"""


def bindings(spark, sf_dir):
    return routing.bind_routes(agency_evidence(spark, sf_dir), registry_evidence(spark, sf_dir))


@query("routing_verdict", _ROUTES + """
 SELECT kldi_id, status, candidate_count, url, reasons FROM routes""")
def routing_verdict(spark, sf_dir):
    return bindings(spark, sf_dir).select(
        F.col("canonical_kldi_id").alias("kldi_id"), "status", "candidate_count",
        F.col("official_lpse_url").alias("url"),
        F.array_join("rejection_reasons", ";").alias("reasons"))


@query("routing_staleness", _ROUTES + """
 SELECT CASE WHEN status = 'ROUTING_ACTIVE' THEN 'ROUTING_STALE' ELSE status END AS status,
  count(*) AS agencies FROM routes GROUP BY 1""")
def routing_staleness(spark, sf_dir):
    checked = routing.validate_routes(bindings(spark, sf_dir), registry_version="sha256:new")
    return checked.groupBy("status").agg(F.count("*").alias("agencies"))


@query("routing_lookup", _ROUTES + """
 SELECT kldi_id AS canonical_kldi_id, url AS route_url FROM routes
 WHERE status = 'ROUTING_ACTIVE'""")
def routing_lookup(spark, sf_dir):
    return routing.routes(bindings(spark, sf_dir))


@query("agency_names", """
 SELECT CAST(o_custkey % 97 AS VARCHAR) AS canonical_kldi_id, count(DISTINCT o_orderpriority)
  AS names, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END
  AS source_kldi_name FROM orders GROUP BY 1""")
def agency_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 97).cast("string").alias("k"), "o_orderpriority")
    return routing.agency_names(rows, "k", "o_orderpriority")


@query("cohort_routing", with_packages("""
 SELECT g.* FROM (SELECT "idKldi" AS id_kldi, count(*) AS members,
   CASE WHEN n_nationkey % 5 = 2 THEN 'ROUTING_REJECTED' ELSE 'ROUTING_ACTIVE' END
     AS routing_status, CASE WHEN n_nationkey % 5 = 2 THEN '' ELSE 'https://p/' || "idKldi" END
     AS official_lpse_url
   FROM cohort JOIN agencies USING ("idKldi") GROUP BY ALL) g""", TAXONOMY_CTE, COHORT_CTE))
def cohort_routing(spark, sf_dir):
    """Product cohort grouped by agency; agencies of one kind have two acquisitions."""
    cohort = taxonomy.potential_matches(plan_candidates(spark, sf_dir))
    number = F.regexp_replace("id_kldi", "K-", "").cast("int")
    plan = F.col("planned_procurement_id").cast("long")
    cohort = cohort.withColumn("acquisition_id", F.when(
        (number % 5 == 2) & (plan % 2 == 0), "run-2").otherwise("run-1"))
    names = agencies(spark, sf_dir)
    evidence = names.select(
        F.col("idKldi").alias("canonical_kldi_id"), F.col("n_name").alias("source_kldi_name"),
        F.lit("run-1").alias("acquisition_run_id"), F.lit("r").alias("receipt_chain_reference"),
        F.lit("h").alias("receipt_chain_hash"), F.lit("v").alias("source_version"),
        F.lit("").alias("province"), F.lit("").alias("government_level"))
    portals = names.select(
        F.concat(F.lit("LPSE "), "n_name").alias("lpse_name"),
        F.concat(F.lit("https://p/"), "idKldi").alias("official_lpse_url"),
        F.lit("a").alias("registry_artifact_id"), F.lit("b").alias("registry_artifact_hash"),
        F.lit("c").alias("registry_version"), F.lit("").alias("province"),
        F.lit("").alias("government_level"))
    groups = routing.cohort_routes(cohort, routing.bind_routes(evidence, portals))
    return groups.select("id_kldi", "members", "routing_status", "official_lpse_url")


# ---- products --------------------------------------------------------------------------------
_LINES = ", ".join(
    f"({S.quote(i)}, {S.quote(c)}, [{', '.join(map(S.quote, OR.CATEGORY_ALIASES[c]))}], "
    f"[{', '.join(S.quote(k) for k in ks)}])" for i, c, ks in OR.PRODUCT_LINES)
PRODUCT_CTE = f"""
lines(product_id, category, needs, words) AS (VALUES {_LINES}),
hits AS (SELECT product_id, category, institution_name, total_pagu FROM lines, rollup_rows
  WHERE list_has_any(string_split(relevant_categories, '; '), needs)
     OR len(list_filter(words, lambda w: contains(lower(relevant_categories || ' ' || ex), w)))
        > 0)"""


@query("product_match", with_packages(
    "SELECT product_id, institution_name FROM hits", RELEVANT_CTE, ROLLUP_CTE, PRODUCT_CTE))
def product_match(spark, sf_dir):
    return products.match_products(products.seed_products(spark), rollup(spark, sf_dir)).select(
        "product_id", "institution_name")


@query("product_summary", with_packages(
    """SELECT product_id, category, count(institution_name) AS matched_institutions,
       coalesce(sum(total_pagu), 0) AS matched_pagu FROM lines LEFT JOIN hits
       USING (product_id, category) GROUP BY 1, 2""", RELEVANT_CTE, ROLLUP_CTE, PRODUCT_CTE))
def product_summary(spark, sf_dir):
    return products.product_summary(products.seed_products(spark), rollup(spark, sf_dir))


@query("unique_budget", with_packages(
    """SELECT (SELECT count(DISTINCT category) FROM lines) AS categories,
       count(*) AS matched_institutions, sum(total_pagu) AS matched_pagu
       FROM (SELECT DISTINCT institution_name, total_pagu FROM hits)""",
    RELEVANT_CTE, ROLLUP_CTE, PRODUCT_CTE))
def unique_budget(spark, sf_dir):
    return products.product_kpis(products.seed_products(spark), rollup(spark, sf_dir))


@query("part_keyword_match", """
 SELECT doc_id, keyword FROM documents, (SELECT DISTINCT lower(p_type) AS keyword FROM part
   UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) FROM part)
 WHERE contains(lower(text), keyword)""")
def part_keyword_match(spark, sf_dir):
    """Part words found anywhere in the documents."""
    words = table(spark, sf_dir, "part").select(F.explode(F.array(
        F.lower("p_type"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))))).alias(
        "keyword")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return products.keyword_hits(docs, "doc_id", "t", words).select("doc_id", "keyword")


@query("product_feed", """
 SELECT CASE WHEN p_partkey % 4 = 0 THEN 'catalog-' || replace(p_name, ' ', '-') ELSE
   CAST(p_partkey AS VARCHAR) END AS id, p_name AS name, 'IT_HARDWARE' AS category,
   p_brand AS brand, 'Pending price verification' AS price,
   array_to_string(list_concat(['it_hardware'], list_filter(string_split(
     lower(p_name), ' '), lambda w: length(w) > 2)), ';') AS kw FROM part""")
def product_feed(spark, sf_dir):
    feed = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string")).alias("kode_produk"),
        F.col("p_name").alias("nama_produk"), F.col("p_brand").alias("merek"),
        F.lit(None).cast("string").alias("harga"))
    rows = products.normalize_feed(feed, "2026-01-01")
    return rows.select("id", "name", "category", "brand", "price",
                       F.array_join("keywords", ";").alias("kw"))


@query("product_filter", """
 SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3' AND contains(lower(p_name || ' ' ||
  p_type), 'e') AND p_type = 'ECONOMY'""")
def product_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.col("p_name").alias("name"),
        F.split("p_name", " ").alias("keywords"),
        *[F.lit("").alias(c) for c in ("provider", "principal", "subcategory", "status",
                                       "source", "evidence_status")])
    return filters.products_where(rows, brand="Brand#3", category="ECONOMY", text="E").select(
        "id")


# ---- prospects -------------------------------------------------------------------------------
def order_prospects(spark, sf_dir):
    """Customers as prospects with an outreach status taken from their number."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("inst-"), key.cast("string")).alias("institution_id"),
        F.col("c_name").alias("institution_name"), key,
        pick(["NOT_CONTACTED", "DRAFT_GENERATED", "UNDER_REVIEW", "APPROVED", "READY_TO_SEND",
              "SENT", "CLOSED_WON", "CLOSED_LOST", "SEND_FAILED"], key).alias("outreach_status"),
        F.lit(1).alias("total_relevant_packages"))


_STATUS = pick_sql(["NOT_CONTACTED", "DRAFT_GENERATED", "UNDER_REVIEW", "APPROVED",
                    "READY_TO_SEND", "SENT", "CLOSED_WON", "CLOSED_LOST", "SEND_FAILED"],
                   "c_custkey")


@query("merge_contacts", """
 WITH l AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS last_order FROM orders
            GROUP BY 1)
 SELECT c_name AS institution_name, CASE WHEN last_order IS NULL THEN '' ELSE
   'o' || last_order || '@x.id' END AS contact_email, CASE WHEN last_order IS NULL THEN
   'CONTACT_MISSING' WHEN last_order % 2 = 0 THEN 'CONTACT_FOUND' ELSE 'CONTACT_NEEDS_REVIEW'
   END AS contact_status FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def merge_contacts(spark, sf_dir):
    key = F.col("o_orderkey")
    imported = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit(" "), "c_name").alias("institution_name"), key.alias("position"),
        F.concat(F.lit("o"), key.cast("string"), F.lit("@x.id ")).alias("contact_email"),
        F.when(key % 2 == 0, "https://x.id").otherwise(" ").alias("contact_source_url"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "official_website", "contact_verification_status", "contact_verified_at",
            "contact_verified_by", "contact_verification_source")])
    return prospects.merge_contacts(order_prospects(spark, sf_dir), imported, "position").select(
        "institution_name", "contact_email", "contact_status")


def workflow_drafts(spark, sf_dir):
    """Draft state of every third institution."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where(key % 3 == 0)
    state = pick(["GENERATED", "UNDER_REVIEW", "APPROVED", "READY_TO_SEND", "SENT"], key)
    draft = F.struct(
        state.alias("status"), state.alias("review_status"), F.lit("x").alias("text"),
        (key % 5 >= 2).alias("approved"), (key % 5 == 3).alias("ready_to_send"),
        (key % 5 == 4).alias("sent"), F.lit("2026-01-01").alias("updated_at"),
        F.lit(1).cast("long").alias("version"))
    return rows.select(F.concat(F.lit("inst-"), key.cast("string")).alias("institution_id"),
                       draft.alias("draft"))


def staged(spark, sf_dir):
    rows = prospects.with_workflow(order_prospects(spark, sf_dir), workflow_drafts(spark, sf_dir))
    return rows.withColumn("stage", status.outreach_stage())


_STAGED = f"""
 WITH s AS (SELECT c_custkey AS k, {_STATUS} AS st, c_custkey % 3 = 0 AS has,
   c_custkey % 5 AS d FROM customer),
 g AS (SELECT *, CASE WHEN has THEN ['Drafts', 'Under Review', 'Approved', 'Ready to Send',
   'Sent'][1 + CAST(d AS INTEGER)] WHEN contains(st, 'FAILED') THEN 'Failed' WHEN st = 'SENT'
   THEN 'Sent' WHEN st = 'READY_TO_SEND' THEN 'Ready to Send' WHEN st = 'APPROVED' THEN
   'Approved' WHEN st = 'UNDER_REVIEW' THEN 'Under Review' WHEN contains(st, 'DRAFT') THEN
   'Drafts' END AS stage FROM s)"""


@query("outreach_stage", _STAGED + " SELECT k AS c_custkey, stage FROM g")
def outreach_stage(spark, sf_dir):
    return staged(spark, sf_dir).select("c_custkey", "stage")


@query("stage_funnel", _STAGED + """
 SELECT p AS position, n AS stage, count(k) AS institutions FROM (VALUES (0, 'Drafts'),
  (1, 'Under Review'), (2, 'Approved'), (3, 'Ready to Send'), (4, 'Sent'), (5, 'Failed'))
  v(p, n) LEFT JOIN g ON stage = n GROUP BY 1, 2""")
def stage_funnel(spark, sf_dir):
    return summaries.stage_funnel(staged(spark, sf_dir))


@query("kpi_counts", _STAGED + """
 SELECT count(*) AS institutions, count(*) AS needs,
  count(*) FILTER (st <> 'NOT_CONTACTED' OR has) AS outreach,
  count(*) FILTER (st = 'READY_TO_SEND' OR (has AND d = 3)) AS ready_to_send,
  count(*) FILTER (st = 'UNDER_REVIEW' OR contains(st, 'DRAFT') OR (has AND d = 1))
    AS waiting_approval,
  count(*) FILTER (contains(st, 'DRAFT') OR (has AND d = 0)) AS drafts,
  count(*) FILTER (st = 'SENT' OR (has AND d = 4)) AS follow_ups FROM g""")
def kpi_counts(spark, sf_dir):
    return summaries.home_kpis(staged(spark, sf_dir))


@query("outreach_kpis", _STAGED + """
 SELECT count(*) FILTER (contains(st, 'DRAFT') OR (has AND d = 0)) AS drafts,
  count(*) FILTER (st = 'UNDER_REVIEW' OR (has AND d = 1)) AS under_review,
  count(*) FILTER (st = 'APPROVED' OR (has AND d >= 2)) AS approved,
  count(*) FILTER (st = 'READY_TO_SEND' OR (has AND d = 3)) AS ready_to_send,
  count(*) FILTER (st = 'SENT' OR (has AND d = 4)) AS sent,
  count(*) FILTER (contains(st, 'FAILED')) AS failed FROM g""")
def outreach_kpis(spark, sf_dir):
    return summaries.outreach_kpis(staged(spark, sf_dir))


@query("timeline_labels", f"""
 SELECT c_custkey, CASE WHEN st = 'CLOSED_LOST' THEN 'Kalah' WHEN st = 'CLOSED_WON' THEN
  'Menang' WHEN st = 'SENT' THEN 'Email Terkirim' WHEN st IN ('APPROVED', 'READY_TO_SEND') THEN
  'Draf Disetujui' WHEN contains(st, 'DRAFT') OR st = 'UNDER_REVIEW' THEN 'Draf Email Dibuat'
  ELSE 'Belum ada aktivitas CRM' END AS label
 FROM (SELECT c_custkey, {_STATUS} AS st FROM customer)""")
def timeline_labels(spark, sf_dir):
    return order_prospects(spark, sf_dir).select("c_custkey", prospects.timeline_label(
        F.col("outreach_status")).alias("label"))


@query("verified_contacts", """
 WITH p AS (SELECT c_custkey AS k, 'inst-' || c_custkey AS id FROM customer)
 SELECT k AS c_custkey, CASE WHEN k % 4 = 0 THEN 'VERIFIED' ELSE '' END
   AS contact_verification_status, CASE WHEN k % 10 = 3 THEN 'CONTACT_EMAIL_INVALID'
   WHEN k % 10 = 5 THEN 'CONTACT_SOURCE_MISSING' WHEN k % 10 = 7 THEN 'CONTACT_NEEDS_REVIEW'
   WHEN k % 4 <> 0 THEN 'CONTACT_VERIFICATION_MISSING' ELSE 'OK' END AS code FROM p""")
def verified_contacts(spark, sf_dir):
    """Verifications that agree in all four parts for every fourth prospect."""
    from lumbung.functions import web

    key = F.col("c_custkey")
    rows = order_prospects(spark, sf_dir).withColumns({
        "contact_email": F.when(key % 10 == 3, "broken").otherwise(F.concat(
            F.lit("A"), key.cast("string"), F.lit("@x.id"))),
        "contact_source_url": F.when(key % 10 == 5, " ").otherwise("https://x.id/c#top"),
        "contact_status": F.when(key % 10 == 7, "CONTACT_NEEDS_REVIEW").otherwise(
            "CONTACT_FOUND")})
    url = web.https_url(F.col("contact_source_url"))
    records = rows.select(
        "institution_id", F.lower("contact_email").alias("email"), url.alias("source_url"),
        F.lit("VERIFIED").alias("status"), F.lit("2026-01-01").alias("verified_at"),
        F.lit("op").alias("verified_by"),
        F.lit(OR.CONTACT_VERIFICATION_SOURCE).alias("verification_source"),
        F.when(key % 4 == 0, web.contact_fingerprint(
            F.col("institution_id"), F.col("contact_email"), F.col("contact_source_url"))
        ).otherwise("other").alias("evidence_fingerprint"))
    joined = prospects.with_verification(rows, records)
    return joined.select("c_custkey", "contact_verification_status",
                         status.verification_code(F.col("institution_id")).alias("code"))


# ---- contracts -------------------------------------------------------------------------------
def _provenance(kind, acquisition):
    return F.struct(
        F.lit(kind).alias("source_kind"), F.lit("table").alias("source_locator"),
        F.lit("2026-01-01T00:00:00Z").alias("observed_at"), acquisition.alias("acquisition_id"),
        F.lit("receipt").alias("raw_receipt_id"), F.lit("1").alias("schema_version"),
        F.lit("TRUSTED_ACQUISITION").alias("source_maturity"))


def raw_plans(spark, sf_dir):
    p = packages(spark, sf_dir)
    return p.select(
        F.col("id").cast("string").alias("planned_procurement_id"),
        F.col("id").cast("string").alias("source_rup_id"),
        F.col("idSatker").cast("string").alias("id_satker"),
        F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("idKldi")).alias("id_kldi"),
        F.col("satuanKerja").alias("institution_name"), F.col("kldi").alias("kldi_name"),
        F.col("paket").alias("package_title"),
        F.col("idSatker").cast("string").alias("buyer_identity_key"),
        _provenance("CURRENT_SIRUP", F.lit("run-1")).alias("provenance"))


@query("contract_violations", """
 SELECT CAST(o_orderkey AS VARCHAR) AS planned_procurement_id, 'id_kldi is required'
  AS violations FROM orders WHERE o_orderkey % 9 = 0""")
def contract_violations(spark, sf_dir):
    rows = raw_plans(spark, sf_dir).withColumn(
        "violations", contracts.contract_violations("IDENTITY"))
    return rows.where(F.size("violations") > 0).select(
        "planned_procurement_id", F.array_join("violations", ";").alias("violations"))


def decision_log(spark, sf_dir):
    return contracts.decide(raw_plans(spark, sf_dir), "IDENTITY",
                            F.lit("2026-01-02T00:00:00Z"), F.array(F.lit("evidence")))


@query("decision_log", """
 SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'IDENTITY' AS kind, '{"id_satker":"' ||
  o_custkey || '"}' AS bindings FROM orders WHERE o_orderkey % 9 <> 0""")
def decision_log_query(spark, sf_dir):
    return decision_log(spark, sf_dir).select("subject", "kind", "bindings")


@query("decision_log_integrity", """
 SELECT 'contradictory decisions' AS problem, 'IDENTITY/' || o_orderkey AS key FROM orders
 WHERE o_orderkey % 9 <> 0 AND o_orderkey % 10 = 1
 UNION ALL SELECT 'malformed', 'bad-' || o_orderkey FROM orders
 WHERE o_orderkey % 9 <> 0 AND o_orderkey % 100 = 7""")
def decision_log_integrity(spark, sf_dir):
    """The log plus decisions that say something else, and records without evidence."""
    log = decision_log(spark, sf_dir)
    number = F.col("subject").cast("long")
    other = log.where(number % 10 == 1).withColumns({
        "bindings": F.lit("{}"), "decision_id": F.concat(F.lit("x-"), "subject")})
    bad = log.where(number % 100 == 7).withColumns({
        "evidence_references": F.array().cast("array<string>"),
        "decision_id": F.concat(F.lit("bad-"), "subject"),
        "subject": F.concat(F.lit("bad-"), "subject")})
    return contracts.decision_log_violations(log.unionByName(other).unionByName(bad))


@query("outreach_eligibility", """
 SELECT CAST(o_orderkey AS VARCHAR) AS planned_procurement_id, CASE WHEN o_orderkey % 9 <> 0 AND
   o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'ELIGIBLE_FOR_REVIEW' ELSE 'NOT_ELIGIBLE' END
   AS eligibility_state, array_to_string(list_filter([
   CASE WHEN o_orderkey % 9 = 0 THEN 'CURRENT_RUP_NOT_VERIFIED' END,
   CASE WHEN o_orderkey % 2 <> 0 THEN 'PRODUCT_COMPATIBILITY_NOT_VERIFIED' END,
   CASE WHEN o_custkey % 3 <> 0 THEN 'CONTACT_NOT_VERIFIED' END,
   CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN
    'EXPLICIT_APPROVAL_GATE_NOT_IMPLEMENTED' END], lambda x: x IS NOT NULL), ';')
   AS reason_codes FROM orders""")
def outreach_eligibility(spark, sf_dir):
    plans = contracts.verified_by(raw_plans(spark, sf_dir), decision_log(spark, sf_dir),
                                  "IDENTITY")
    number = F.col("planned_procurement_id").cast("long")
    fits = plans.where(number % 2 == 0).select(
        "planned_procurement_id", F.concat(F.lit("fit-"), "planned_procurement_id").alias(
            "compatibility_id"), F.lit(True).alias("verified"))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("buyer_identity_key"),
        F.concat(F.lit("contact-"), "c_custkey").alias("contact_evidence_id"),
        (F.col("c_custkey") % 3 == 0).alias("verified"))
    rows = contracts.outreach_eligibility(plans, fits, people)
    return rows.select("planned_procurement_id", "eligibility_state",
                       F.array_join("reason_codes", ";").alias("reason_codes"))


@query("exact_links", """
 SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS planned_procurement_id, 'lpse:' || l_suppkey ||
   '-' || l_partkey AS execution_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 WHERE l_quantity > 10""")
def exact_links(spark, sf_dir):
    """Shipments as executions that name their plan; small ones carry no code."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.concat(F.lit("lpse:"), "l_suppkey"), "l_partkey").alias(
            "execution_id"),
        F.array(F.struct(F.when(F.col("l_quantity") > 10, F.col("l_orderkey").cast(
            "string")).otherwise("").alias("kode_rup"))).alias("kode_rup_rows"))
    plans = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("planned_procurement_id"),
        F.col("o_orderkey").cast("string").alias("source_rup_id"))
    return contracts.authoritative_links(contracts.exact_links(rows, plans)).select(
        "planned_procurement_id", "execution_id").distinct()


@query("execution_candidates", """
 SELECT 'lpse:' || l_orderkey AS execution_id, CASE WHEN l_returnflag = 'N' THEN
  'stage_or_status is required' ELSE '' END AS violations, year(l_shipdate) AS source_year,
  count(*) AS rows FROM lineitem GROUP BY ALL""")
def execution_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("package_code"),
        F.lit("name").alias("package_name"), F.lit("").alias("institution_name"),
        F.when(F.col("l_returnflag") == "N", "").otherwise("Selesai").alias("stage_or_status"),
        F.lit("").alias("method"), F.year("l_shipdate").cast("string").alias("fiscal_year"),
        F.lit("891,2 M").alias("hps_or_pagu"))
    out = contracts.execution_candidates(rows)
    return out.groupBy("execution_id", F.array_join("violations", ";").alias("violations"),
                       "source_year").agg(F.count("*").alias("rows"))
