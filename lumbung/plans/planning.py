"""Queries over planning packages: filters, classification, rollups, leads and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.functions import numbers as N
from lumbung.functions import text as X
from lumbung.functions import web
from lumbung.functions.ranking import first_k, top_n
from lumbung.operators import filters, leads, outreach, status, summaries, taxonomy
from lumbung.plans import sqltext as S
from lumbung.plans.registry import query
from lumbung.plans.views import packages, table, with_packages
from lumbung.rules import evidence as ER
from lumbung.rules import health as HR
from lumbung.rules import outreach as OR
from lumbung.rules import taxonomy as TR

# ---- rollup (SQL shared by several statements) -----------------------------------------------
_CATS = S.labels_where({c: S.bounded("lower(paket)", t) for c, t in OR.CATEGORY_TERMS.items()})
_LEVEL = S.first_class("lower(institution_display_name)", OR.TARGET_LEVELS, "'OTHER'")
RELEVANT_CTE = f"""
relevant AS (
  SELECT *, "satuanKerja" AS institution_name FROM (
    SELECT *, CASE WHEN {S.bounded('lower(paket)', OR.CATEGORY_VETO)} THEN [] ELSE {_CATS} END
             AS cats FROM packages)
  WHERE len(cats) > 0)"""
ROLLUP_CTE = f"""
example AS (
  SELECT institution_name, string_agg(paket || ' [' || id || ']', ' | ' ORDER BY id) AS ex
  FROM (SELECT *, row_number() OVER (PARTITION BY institution_name ORDER BY id) AS rn
        FROM relevant) WHERE rn <= 5 GROUP BY 1),
base AS (
  SELECT institution_name, count(*) AS total_relevant_packages, sum(pagu) AS total_pagu,
         array_to_string(list_sort(list_distinct(list(pemilihan))), '; ') AS months_found,
         array_to_string(list_sort(list_distinct(flatten(list(cats)))), '; ')
           AS relevant_categories,
         arg_min(kldi, id) AS parent_organization, arg_min("satuanKerja", id) AS work_unit,
         arg_min(lokasi, id) AS location_hint
  FROM relevant GROUP BY 1),
named AS (
  SELECT *, work_unit || ' — ' || parent_organization AS institution_display_name,
         split_part(location_hint, ',', 1) AS province_or_region
  FROM base JOIN example USING (institution_name)),
rollup_rows AS (
  SELECT *, {_LEVEL} AS target_level FROM named)"""
ROLLUP_COLUMNS = ["institution_name", "institution_display_name", "parent_organization",
                  "work_unit", "province_or_region", "location_hint", "total_relevant_packages",
                  "total_pagu", "months_found", "relevant_categories", "example_package_names",
                  "target_level", "send_readiness"]


def rollup(spark, sf_dir):
    return outreach.institution_rollup(packages(spark, sf_dir))


@query("institution_rollup", with_packages(
    """SELECT institution_name, institution_display_name, parent_organization, work_unit,
       province_or_region, location_hint, total_relevant_packages, total_pagu, months_found,
       relevant_categories, ex AS example_package_names, target_level,
       CASE WHEN target_level = 'OTHER' THEN 'NEEDS_REVIEW' ELSE 'READY_FOR_CONTACT_SEARCH' END
         AS send_readiness FROM rollup_rows""", RELEVANT_CTE, ROLLUP_CTE))
def institution_rollup(spark, sf_dir):
    return rollup(spark, sf_dir).select(*ROLLUP_COLUMNS)


@query("institution_rollup_by_month", with_packages(
    """SELECT institution_name, count(*) AS total_relevant_packages, sum(pagu) AS total_pagu
       FROM relevant WHERE pemilihan IN ('May 1996', 'June 1996') GROUP BY 1""", RELEVANT_CTE))
def institution_rollup_by_month(spark, sf_dir):
    rows = outreach.institution_rollup(packages(spark, sf_dir), ["May 1996", "June 1996"])
    return rows.select("institution_name", "total_relevant_packages", "total_pagu")


@query("contact_template", with_packages(
    """SELECT institution_name, target_level, total_relevant_packages, '' AS contact_email,
       '' AS contact_notes FROM rollup_rows""", RELEVANT_CTE, ROLLUP_CTE))
def contact_template(spark, sf_dir):
    return outreach.contact_template(rollup(spark, sf_dir)).select(
        "institution_name", "target_level", "total_relevant_packages", "contact_email",
        "contact_notes")


_RESEARCH_HIT = "list_has_any(string_split(relevant_categories, '; '), [" + ", ".join(
    map(S.quote, OR.RESEARCH_PRIORITY_CATEGORIES)) + "])"
_RANK = "CASE target_level " + " ".join(
    f"WHEN '{v}' THEN {i}" for i, v in enumerate(OR.RESEARCH_LEVEL_ORDER)) + " ELSE 8 END"


@query("research_batch", with_packages(
    f"""SELECT institution_name, target_level, {_RANK} AS level_rank, total_relevant_packages,
        total_pagu FROM rollup_rows WHERE {_RESEARCH_HIT}
        ORDER BY level_rank, total_relevant_packages DESC, total_pagu DESC,
                 institution_display_name LIMIT 100""", RELEVANT_CTE, ROLLUP_CTE))
def research_batch(spark, sf_dir):
    return outreach.research_batch(rollup(spark, sf_dir)).select(
        "institution_name", "target_level", "level_rank", "total_relevant_packages",
        "total_pagu")


@query("multi_label", with_packages(
    "SELECT id, array_to_string(cats, ';') AS categories FROM relevant", RELEVANT_CTE))
def multi_label(spark, sf_dir):
    return outreach.relevant_packages(packages(spark, sf_dir)).select(
        "id", F.array_join("categories", ";").alias("categories"))


@query("target_level", with_packages(
    f"""SELECT institution_display_name AS name, {_LEVEL} AS target_level FROM
        (SELECT DISTINCT "satuanKerja" || ' — ' || kldi AS institution_display_name
         FROM packages)"""))
def target_level(spark, sf_dir):
    names = packages(spark, sf_dir).select(X.display_name(
        F.col("satuanKerja"), F.col("kldi")).alias("name")).distinct()
    return names.withColumn("target_level", outreach.target_level(F.col("name")))


@query("facets", with_packages(
    """SELECT DISTINCT unnest(string_split(relevant_categories, '; ')) AS value
       FROM rollup_rows""", RELEVANT_CTE, ROLLUP_CTE))
def facets(spark, sf_dir):
    return filters.facet_values(rollup(spark, sf_dir), "relevant_categories", ";")


@query("facets_plain", with_packages("SELECT DISTINCT metode AS value FROM packages"))
def facets_plain(spark, sf_dir):
    return filters.facet_values(packages(spark, sf_dir), "metode")


# ---- filters and top-k -----------------------------------------------------------------------
@query("package_filter", with_packages(
    """SELECT id, paket, pagu FROM packages
       WHERE regexp_matches(lower(pemilihan), '1997')
         AND regexp_matches(lower(paket || ' ' || "jenisPengadaan" || ' ' || metode),
                            'printer|laptop')
         AND regexp_matches(lower("satuanKerja" || ' ' || kldi), 'dinas|rsud')
         AND "idBulan" = 5"""))
def package_filter(spark, sf_dir):
    return filters.packages_where(packages(spark, sf_dir), year=1997, keyword="printer|laptop",
                                  institution="dinas|rsud", month=5).select("id", "paket", "pagu")


@query("package_filter_year", with_packages(
    """SELECT count(*) AS rows_found, sum(pagu) AS pagu FROM packages WHERE regexp_matches(
       lower(pemilihan || ' ' || paket || ' ' || "satuanKerja" || ' ' || kldi), '1998')"""))
def package_filter_year(spark, sf_dir):
    rows = filters.packages_of_year(packages(spark, sf_dir), 1998)
    return rows.agg(F.count("*").alias("rows_found"), summaries.total("pagu").alias("pagu"))


@query("top_packages", with_packages(
    """SELECT id, paket, pagu FROM packages ORDER BY pagu DESC NULLS LAST, id DESC
       LIMIT 500"""))
def top_packages(spark, sf_dir):
    return top_n(packages(spark, sf_dir), [F.desc_nulls_last("pagu"), F.desc("id")], 500).select(
        "id", "paket", "pagu")


@query("first_k_per_group", with_packages(
    """SELECT "satuanKerja" AS unit, id, rn AS position FROM (
       SELECT *, row_number() OVER (PARTITION BY "satuanKerja" ORDER BY id) AS rn
       FROM packages) WHERE rn <= 3"""))
def first_k_per_group(spark, sf_dir):
    rows = first_k(packages(spark, sf_dir).select("satuanKerja", "id"), ["satuanKerja"],
                   [F.col("id")], 3)
    return rows.select(F.col("satuanKerja").alias("unit"), "id", F.col("_rank").alias("position"))


@query("month_histogram", with_packages(
    """SELECT m AS month, count(id) AS rows FROM range(1, 13) t(m)
       LEFT JOIN packages ON "idBulan" = m GROUP BY 1"""))
def month_histogram(spark, sf_dir):
    return summaries.month_histogram(packages(spark, sf_dir), "pemilihan")


@query("frequency_tables", with_packages(
    """SELECT 'metode' AS "column", metode AS value, count(*) AS rows FROM packages GROUP BY 2
       UNION ALL SELECT 'sumberDana', "sumberDana", count(*) FROM packages GROUP BY 2
       UNION ALL SELECT 'jenisPengadaan', "jenisPengadaan", count(*) FROM packages GROUP BY 2"""))
def frequency_tables(spark, sf_dir):
    return summaries.frequency(packages(spark, sf_dir),
                               ["metode", "sumberDana", "jenisPengadaan"])


@query("token_keyword_hits", with_packages(
    "SELECT k AS keyword, p - 1 AS position, n AS hits FROM (SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT {S.quote(k)} AS k, {i + 1} AS p, count(*) FILTER (contains(lower(paket), "
        f"{S.quote(k)})) AS n FROM packages" for i, k in enumerate(ER.TARGET_KEYWORDS))
    + ")) WHERE n > 0"))
def token_keyword_hits(spark, sf_dir):
    return summaries.keyword_hits(packages(spark, sf_dir), "paket", ER.TARGET_KEYWORDS)


# ---- health leads ----------------------------------------------------------------------------
_ALLTEXT = """lower(paket || ' ' || "satuanKerja" || ' ' || kldi || ' ' || lokasi || ' ' ||
 "jenisPengadaan")"""
_COMBINED = """(paket || ' ' || "satuanKerja" || ' ' || kldi || ' ' || lokasi || ' ' ||
 "jenisPengadaan")"""


def _health(text, terms):
    return S.whole_or_inside(text, terms, HR.WHOLE_WORDS)


_IS_LEAD = f"""{_health(_ALLTEXT, HR.CONTEXT_KEYWORDS)}
 AND NOT {_health('lower(paket)', HR.EXCLUDE_KEYWORDS)}
 AND ({_health('lower(paket)', HR.EQUIPMENT_KEYWORDS)} OR "jenisPengadaan" = 'Barang')"""
_MATCHES = S.labels_where({k: _health("lower(txt)", [k])
                           for k in sorted(set(HR.KEYWORDS), key=str.lower)})
_STRONG = "[" + ", ".join(S.quote(k.lower()) for k in HR.EQUIPMENT_KEYWORDS) + "]"
_CONTEXT = "[" + ", ".join(map(S.quote, HR.CONTEXT_KEYWORDS)) + "]"
LEADS_CTE = f"""
lead_base AS (SELECT *, {_COMBINED} AS txt FROM packages WHERE {_IS_LEAD}),
lead_match AS (SELECT *, {_MATCHES} AS hits FROM lead_base),
lead_rows AS (
  SELECT id, "satuanKerja" AS institution_name, split_part(lokasi, ', ', 1) AS province, pagu,
    {S.first_class('lower(txt)', HR.SECTORS, "'Public Sector'")} AS sector,
    {S.first_class('lower(txt)', HR.INSTITUTION_TYPES, "'Public Institution'")}
      AS institution_type,
    coalesce({S.first_class('lower(txt)', HR.EQUIPMENT_CLASSES, 'NULL')},
      CASE WHEN list_has_any(list_transform(hits, lambda x: lower(x)), {_CONTEXT})
           THEN 'Healthcare Equipment / Supplies' ELSE 'Healthcare Procurement' END)
      AS equipment_category,
    array_to_string(hits, ', ') AS raw_keywords_matched,
    CASE WHEN list_has_any(list_transform(hits, lambda x: lower(x)), {_STRONG}) THEN 'Medium'
         ELSE 'Low' END AS data_confidence,
    txt
  FROM lead_match),
leads AS (
  SELECT *, CASE WHEN pagu >= 1000000000 AND equipment_category <> 'Healthcare Procurement'
                 THEN 'High' WHEN pagu >= 250000000 THEN 'Medium'
                 WHEN pagu >= 50000000 THEN 'Medium' ELSE 'Low' END AS opportunity_priority
  FROM lead_rows)"""


def health_leads(spark, sf_dir):
    rows = packages(spark, sf_dir).where(leads.is_health_lead())
    return leads.build_leads(rows, 2026)


@query("lead_predicate", with_packages(f"SELECT id FROM packages WHERE {_IS_LEAD}"))
def lead_predicate(spark, sf_dir):
    return packages(spark, sf_dir).where(leads.is_health_lead()).select("id")


@query("lead_rows", with_packages(
    """SELECT CAST(id AS VARCHAR) AS rup_id, institution_name, province, sector,
       institution_type, equipment_category, pagu AS budget_value, raw_keywords_matched,
       data_confidence, opportunity_priority,
       'Research official contact before outreach' AS recommended_next_action,
       'Missing direct contact' AS contact_readiness FROM leads""", LEADS_CTE))
def lead_rows(spark, sf_dir):
    return health_leads(spark, sf_dir).select(
        "rup_id", "institution_name", "province", "sector", "institution_type",
        "equipment_category", "budget_value", "raw_keywords_matched", "data_confidence",
        "opportunity_priority", "recommended_next_action", "contact_readiness")


@query("lead_ordering", with_packages(
    """SELECT CAST(id AS VARCHAR) AS rup_id, opportunity_priority, pagu AS budget_value_idr
       FROM leads ORDER BY CASE opportunity_priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1
       ELSE 2 END, pagu DESC, id""", LEADS_CTE))
def lead_ordering(spark, sf_dir):
    return health_leads(spark, sf_dir).orderBy(*leads.lead_order()).select(
        "rup_id", "opportunity_priority", "budget_value_idr")


@query("lead_summary", with_packages(
    """SELECT count(*) AS rows_exported, count(DISTINCT institution_name) AS unique_institutions,
       sum(pagu) AS total_budget, 0 AS with_email, 0 AS with_phone, 0 AS with_whatsapp
       FROM leads""", LEADS_CTE))
def lead_summary(spark, sf_dir):
    return leads.lead_totals(health_leads(spark, sf_dir))


@query("lead_top_categories", with_packages(
    """SELECT equipment_category AS value, count(*) AS rows FROM leads GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 10""", LEADS_CTE))
def lead_top_categories(spark, sf_dir):
    return leads.lead_top_values(health_leads(spark, sf_dir), "equipment_category")


@query("missing_contacts", with_packages(
    """SELECT CAST('sirup_raw.rup_id=' || id AS VARCHAR) AS source_url_or_reference,
       opportunity_priority, equipment_category FROM leads""", LEADS_CTE))
def missing_contacts(spark, sf_dir):
    return leads.missing_contacts(health_leads(spark, sf_dir)).select(
        "source_url_or_reference", "opportunity_priority", "equipment_category")


# ---- taxonomy --------------------------------------------------------------------------------
_TITLE = "trim(regexp_replace(lower(paket), '[^a-z0-9_]+', ' ', 'g'))"
_GOVERNED = "' ' || title || ' '"
for _term in TR.UNVERIFIED_TERMS:
    _GOVERNED = f"replace({_GOVERNED}, ' {_term} ', '  ')"


def _family_sql(family: str) -> str:
    parts = []
    for term in TR.FAMILY_TERMS[family]:
        cond = f"contains(governed, ' {term} ')"
        if (family, term) == TR.CONSUMABLE_PHRASE_SUPPRESSES:
            cond = f"({cond} AND NOT contains(' ' || title || ' ', ' centrifuge tube '))"
        parts.append(cond)
    return "(" + " OR ".join(parts) + ")"


_CONSUMABLE = "(" + " OR ".join(
    f"regexp_matches(title, {S.quote(p)})" for p in TR.PRINTING_CONSUMABLE_PATTERNS) + ")"
# Without look-behind: blank the consumable spans, longest constructions first, then look again.
_RESIDUE = "title"
for _p in [r"\b(perlengkapan printer berupa toner|kebutuhan printer tinta dan pita printer)\b",
           r"\b(tinta|pita|cartridge|toner untuk|toner|refill ink|refil ink|refill|refil) "
           r"printer\b"]:
    _RESIDUE = f"regexp_replace({_RESIDUE}, {S.quote(_p)}, ' # ', 'g')"
_FAMILY_CONDS = {f: (_CONSUMABLE if f == "PRINTING_CONSUMABLES" else
                     f"regexp_matches({_RESIDUE}, '\\bprinter\\b')" if f == "PRINTING_HARDWARE"
                     else _family_sql(f)) for f in TR.FAMILIES}
_STATE_CASES = " ".join(
    f"WHEN {S.has_any_phrase('title', terms)} THEN '{label}'"
    for label, terms in TR.CONTEXT_TERMS.items())
TAXONOMY_CTE = f"""
titles AS (SELECT id, pagu, "idKldi", "satuanKerja", {_TITLE} AS title,
                  trim(regexp_replace(lower("jenisPengadaan"), '[^a-z0-9_]+', ' ', 'g')) AS kind
           FROM packages),
governed_titles AS (SELECT *, {_GOVERNED} AS governed FROM titles),
families AS (SELECT *, {S.labels_where(_FAMILY_CONDS)} AS fams, {_CONSUMABLE} AS consumable
             FROM governed_titles),
classified AS (
  SELECT *, CASE {_STATE_CASES}
    WHEN (consumable AND len(list_filter(fams, lambda x: x <> 'PRINTING_CONSUMABLES')) = 0)
      OR contains(' ' || title || ' ', ' centrifuge tube ') THEN 'PARTS_CONSUMABLE'
    WHEN {S.has_any_phrase('title', TR.PURCHASE_TERMS)} THEN 'PURCHASE_EXPLICIT'
    WHEN len(fams) > 0 THEN 'PRODUCT_ONLY_UNCONTRADICTED'
    WHEN {S.has_any_phrase('kind', TR.PURCHASE_TERMS)} THEN 'PURCHASE_EXPLICIT'
    ELSE 'NO_GOVERNED_DEMAND_MATCH' END AS semantic_state
  FROM families)"""


@query("demand_taxonomy", with_packages(
    """SELECT id, array_to_string(fams, ';') AS demand_families, semantic_state
       FROM classified""", TAXONOMY_CTE))
def demand_taxonomy(spark, sf_dir):
    rows = taxonomy.classify(packages(spark, sf_dir).select("id", "paket", "jenisPengadaan"),
                             "paket", "jenisPengadaan")
    return rows.select("id", F.array_join("demand_families", ";").alias("demand_families"),
                       "semantic_state")


@query("taxonomy_counts", with_packages(
    """SELECT semantic_state, count(*) AS rows, sum(CASE WHEN len(fams) > 0 THEN 1 ELSE 0 END)
       AS matched_rows, count(DISTINCT CASE WHEN len(fams) > 0 THEN "satuanKerja" END)
       AS buyer_units FROM classified GROUP BY 1""", TAXONOMY_CTE))
def taxonomy_counts(spark, sf_dir):
    rows = taxonomy.classify(packages(spark, sf_dir), "paket", "jenisPengadaan")
    matched = F.size("demand_families") > 0
    return rows.groupBy("semantic_state").agg(
        F.count("*").alias("rows"), F.count_if(matched).alias("matched_rows"),
        F.count_distinct(F.when(matched, F.col("satuanKerja"))).alias("buyer_units"))


@query("taxonomy_padded_terms", "SELECT doc_id, " + ", ".join(
    f"CAST(contains(' ' || t || ' ', ' {w} ') AS INTEGER) AS has_{w}" for w in
    ("the", "que", "der", "los")) + """ FROM (SELECT doc_id,
    trim(regexp_replace(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS t
    FROM documents)""")
def taxonomy_padded_terms(spark, sf_dir):
    from lumbung.functions.matching import has_phrase, padded

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", padded(X.word_text(F.col("text"))).alias("t"))
    return docs.select("doc_id", *[has_phrase(F.col("t"), w).cast("int").alias(f"has_{w}")
                                   for w in ("the", "que", "der", "los")])


_PRODUCT_SQL = "[" + ", ".join(
    f"CASE WHEN list_contains(fams, '{f}') THEN '{ids[0]}' END"
    for f, ids in sorted(TR.FAMILY_PRODUCTS.items(), key=lambda kv: TR.FAMILIES.index(kv[0]))
) + "]"
COHORT_CTE = f"""
cohort AS (
  SELECT *, list_aggregate(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN
      list_position(p, p[i]) = i THEN p[i] END), 'string_agg', ';') AS matched_product_ids
  FROM (SELECT *, list_filter({_PRODUCT_SQL}, lambda x: x IS NOT NULL) AS p FROM classified)
  WHERE len(p) > 0)"""


def plan_candidates(spark, sf_dir):
    return packages(spark, sf_dir).select(
        F.col("id").cast("string").alias("planned_procurement_id"),
        F.col("idKldi").alias("id_kldi"), F.col("kldi").alias("kldi_name"),
        F.col("satuanKerja").alias("institution_name"), F.col("paket").alias("package_title"),
        F.col("jenisPengadaan").alias("procurement_type"), "pagu")


@query("potential_matches", with_packages(
    """SELECT CAST(id AS VARCHAR) AS planned_procurement_id, "idKldi" AS id_kldi,
       matched_product_ids FROM cohort""", TAXONOMY_CTE, COHORT_CTE))
def potential_matches(spark, sf_dir):
    return taxonomy.potential_matches(plan_candidates(spark, sf_dir)).select(
        "planned_procurement_id", "id_kldi",
        F.array_join("matched_product_ids", ";").alias("matched_product_ids"))


# ---- scalar functions ------------------------------------------------------------------------
_STOP = "[" + ", ".join(map(S.quote, ER.NAME_STOPWORDS)) + "]"


@query("stopword_normalise", f"""SELECT doc_id, array_to_string(list_filter(string_split(
    {S.normalize('text')}, ' '), lambda t: NOT list_contains({_STOP}, t)), ' ') AS name
    FROM documents""")
def stopword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.normalize_name(F.col("text")).alias("name"))


@query("name_keys", with_packages(
    f"""SELECT id, {S.normalize('"satuanKerja"')} || ' || ' || {S.normalize('kldi')} AS pair_key,
        trim(regexp_replace(regexp_replace({S.normalize('kldi')},
          '\\b(kabupaten|kab|kota|provinsi|prov)\\b', '', 'g'), ' +', ' ', 'g')) AS place_key,
        split_part(lokasi, ',', 1) AS region, '20' || substr(pemilihan, -2) AS year_text FROM packages"""))
def name_keys(spark, sf_dir):
    return packages(spark, sf_dir).select(
        "id", X.key_pair(F.col("satuanKerja"), F.col("kldi")).alias("pair_key"),
        X.normalize_place(F.col("kldi")).alias("place_key"),
        X.region_of(F.col("lokasi")).alias("region"),
        X.first_year(F.concat(F.lit("20"), F.substring("pemilihan", -2, 2))).cast("string").alias("year_text"))


_AMOUNT_WORDS = ["juta", "miliar", "ribu", "triliun", ""]


@query("budget_text", """
    WITH t AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(20,2)) AS p,
               o_orderkey % 5 AS w FROM orders)
    SELECT id, CAST(p AS DOUBLE) * [1e6, 1e9, 1e3, 1e12, 1.0][w + 1] AS amount,
           CAST(p AS DOUBLE) AS plain FROM t""")
def budget_text(spark, sf_dir):
    """Amounts printed as "Rp 112.946,26 juta" and read back in both dialects."""
    from lumbung.plans.views import pick

    printed = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(20,2)"), 2),
                          ",.", ".,")
    text = F.concat_ws(" ", F.lit("Rp"), printed, pick(_AMOUNT_WORDS, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), N.parse_budget(text).alias("amount"),
        N.parse_plain_budget(printed).alias("plain"))


_CLASS_CASES = S.first_class("lower(stage)", ER.FACTUAL_STATUS, "NULL")
_PROC_CASES = S.first_class(S.normalize("stage"), ER.PROCUREMENT_STATUS, "'OBSERVED_OTHER'")


@query("factual_status", f"""
    WITH s AS (SELECT o_orderkey AS id, ['Tender Selesai', 'Evaluasi Penawaran',
      'Pemenang Berkontrak', 'Tender Batal', 'Pengumuman Pascakualifikasi', 'Masa Sanggah', '']
      [1 + CAST(o_orderkey % 7 AS INTEGER)] AS stage FROM orders)
    SELECT id, {_CLASS_CASES} AS factual_status, {_PROC_CASES} AS procurement_status FROM s""")
def factual_status(spark, sf_dir):
    from lumbung.plans.views import STAGES, pick

    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), pick(STAGES, F.col("o_orderkey")).alias("stage"))
    return rows.select("id", status.factual_status(F.col("stage")).alias("factual_status"),
                       status.procurement_status(F.col("stage")).alias("procurement_status"))


@query("product_category", "SELECT p_partkey, " + S.first_class(
    "lower(t)", OR.PRODUCT_CATEGORY_TERMS, "'IT_HARDWARE'") + """ AS category FROM (
    SELECT p_partkey, p_name || ' ' || ['Laptop', 'Printer', 'Router', 'Kursi', 'NAS', 'x']
    [1 + CAST(p_partkey % 6 AS INTEGER)] AS t FROM part)""")
def product_category(spark, sf_dir):
    from lumbung.plans.views import pick

    text = F.concat_ws(" ", "p_name", pick(["Laptop", "Printer", "Router", "Kursi", "NAS", "x"],
                                           F.col("p_partkey")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", status.product_category(text).alias("category"))


@query("status_labels", "SELECT CAST(event_id AS BIGINT) AS event_id, CASE event_type "
       "WHEN 'signup' THEN 'Terkirim' WHEN 'click' THEN 'Draf Dibuat' ELSE event_type END "
       "AS label FROM events")
def status_labels(spark, sf_dir):
    code = F.when(F.col("event_type") == "signup", "SENT").when(
        F.col("event_type") == "click", "DRAFT_GENERATED").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("status"))
    return status.with_label(rows, "status").select("event_id", "label")


@query("lookup_urls", with_packages(
    """SELECT id, 'https://spse.inaproc.id/?q=' || replace(paket, ' ', '+') AS tender_url,
       'https://sirup.lkpp.go.id/sirup/ro/penyedia?search=' || id AS plan_url FROM packages"""))
def lookup_urls(spark, sf_dir):
    return packages(spark, sf_dir).select(
        "id", web.tender_lookup_url(F.col("paket")).alias("tender_url"),
        web.plan_lookup_url(F.col("id").cast("string"), F.col("paket")).alias("plan_url"))


@query("contact_fingerprints", """
    SELECT c_custkey, sha256('inst-' || c_custkey || chr(31) || lower(replace(c_name, '#', '.'))
      || '@example.id' || chr(31) || 'https://example.id/' || c_custkey || chr(31) ||
      'OFFICIAL_INSTITUTION_WEBSITE') AS fingerprint FROM customer""")
def contact_fingerprints(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    email = F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.ID "))
    url = F.concat(F.lit("https://EXAMPLE.id/"), key, F.lit("#contact"))
    return table(spark, sf_dir, "customer").select("c_custkey", web.contact_fingerprint(
        F.concat(F.lit("inst-"), key), email, url).alias("fingerprint"))


@query("institution_ids", """
    SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug,
      list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''),
        lambda ch: CAST(ord(ch) AS BIGINT))), lambda h, u: (h * 31 + u) % 4294967296) AS hash_value
    FROM customer""")
def institution_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(
        "c_custkey", web.institution_id(F.col("c_name")).alias("institution_id"))
    return ids.select(
        "c_custkey", F.regexp_replace("institution_id", "-[0-9a-z]+$", "").alias("slug"),
        F.conv(F.regexp_extract("institution_id", "([0-9a-z]+)$", 1), 36, 10).cast("long").alias(
            "hash_value"))


@query("registry_inference", f"""
    WITH s AS (SELECT s_suppkey, s_name, 'LPSE ' || ['Kabupaten', 'Kota', 'Universitas',
      'Provinsi'][1 + CAST(s_suppkey % 4 AS INTEGER)] || ' ' || ['Papua Barat Daya', 'Papua',
      'Maluku Utara', 'Riau', 'Acme'][1 + CAST(s_suppkey % 5 AS INTEGER)] AS name FROM supplier)
    SELECT s_suppkey, name,
      ['Pemerintah Kabupaten', 'Pemerintah Kota', 'Perguruan Tinggi', 'Pemerintah Provinsi']
        [1 + CAST(s_suppkey % 4 AS INTEGER)] AS category,
      CASE s_suppkey % 5 WHEN 0 THEN 'Papua Barat Daya' WHEN 1 THEN 'Papua'
        WHEN 2 THEN 'Maluku Utara' WHEN 3 THEN 'Riau' END AS province,
      CASE WHEN s_suppkey % 4 IN (0, 1) THEN name END AS regency FROM s""")
def registry_inference(spark, sf_dir):
    from lumbung.operators import registry
    from lumbung.plans.views import pick

    key = F.col("s_suppkey")
    name = F.concat_ws(" ", F.lit("LPSE"),
                       pick(["Kabupaten", "Kota", "Universitas", "Provinsi"], key),
                       pick(["Papua Barat Daya", "Papua", "Maluku Utara", "Riau", "Acme"], key))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return rows.select("s_suppkey", "name", registry.category(F.col("name")).alias("category"),
                       registry.province(F.col("name")).alias("province"),
                       registry.regency(F.col("name")).alias("regency"))


# ---- KPIs over the rollup --------------------------------------------------------------------
PROSPECTS_CTE = """
prospects AS (
  SELECT *, row_number() OVER (ORDER BY institution_name) AS pos,
    CASE WHEN CAST(regexp_extract(institution_name, '([0-9]+)$', 1) AS BIGINT) % 3 = 0
         THEN institution_name || '@x.id' ELSE '' END AS contact_email
  FROM rollup_rows)"""


def prospects(spark, sf_dir):
    """Rollup rows with a contact for every third unit number and a status from it."""
    number = F.regexp_extract("institution_name", "([0-9]+)$", 1).cast("long")
    email = F.when(number % 3 == 0, F.concat("institution_name", F.lit("@x.id"))).otherwise("")
    return rollup(spark, sf_dir).withColumn("contact_email", email).withColumn(
        "contact_status", F.when(email != "", "CONTACT_FOUND").otherwise("CONTACT_MISSING"))


@query("institution_kpis", with_packages(
    """SELECT count(*) AS institutions, sum(total_pagu) AS total_pagu,
       count(*) FILTER (contact_email <> '') AS contacts_found, count(*) AS planning_only
       FROM prospects""", RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def institution_kpis(spark, sf_dir):
    return summaries.institution_kpis(prospects(spark, sf_dir))


@query("queue_kpis", with_packages(
    """SELECT count(*) AS institutions, count(*) FILTER (target_level = 'NATIONAL') AS national,
       count(*) FILTER (target_level = 'PROVINCE') AS province,
       count(*) FILTER (target_level IN ('LOCAL_AGENCY', 'HOSPITAL', 'EDUCATION', 'HEALTH_UNIT'))
         AS local_operational,
       count(*) FILTER (contact_email <> '') AS contact_found, 0 AS contact_needs_review,
       count(*) FILTER (contact_email = '') AS contact_missing,
       count(*) FILTER (target_level = 'OTHER') AS needs_review, sum(total_pagu) AS total_pagu
       FROM prospects""", RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def queue_kpis(spark, sf_dir):
    return summaries.queue_kpis(prospects(spark, sf_dir))


@query("contact_and_evidence_kpis", with_packages(
    """SELECT count(*) FILTER (contact_email <> '') AS found, 0 AS needs_review,
       count(*) FILTER (contact_email = '') AS missing, count(*) AS planning_only,
       count(*) AS not_checked FROM prospects""", RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def contact_and_evidence_kpis(spark, sf_dir):
    return summaries.contact_and_evidence_kpis(prospects(spark, sf_dir))


@query("institution_search", with_packages(
    """SELECT institution_name FROM prospects WHERE contact_email <> '' AND contains(lower(
       institution_display_name || ' ' || relevant_categories), 'dinas')""",
    RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def institution_search(spark, sf_dir):
    return filters.search_institutions(
        prospects(spark, sf_dir), contact="FOUND", evidence="SIRUP_PLANNING_ONLY",
        text="Dinas").select("institution_name")


@query("prospect_queue", with_packages(
    """SELECT institution_name, total_pagu FROM prospects
       WHERE contains(months_found, 'May') AND list_contains(string_split(relevant_categories,
       '; '), 'PRINTER') AND contact_email <> '' AND target_level = 'HOSPITAL'""",
    RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def prospect_queue(spark, sf_dir):
    return filters.queue_where(
        prospects(spark, sf_dir), month="May", category="PRINTER", target_level="HOSPITAL",
        send_readiness="READY_FOR_CONTACT_SEARCH", operational="READY_FOR_DRAFT").select(
        "institution_name", "total_pagu")


@query("contact_first_order", with_packages(
    """SELECT institution_name, total_pagu FROM prospects
       ORDER BY CASE WHEN contact_email <> '' THEN 0 ELSE 1 END, institution_name""",
    RELEVANT_CTE, ROLLUP_CTE, PROSPECTS_CTE))
def contact_first_order(spark, sf_dir):
    return prospects(spark, sf_dir).orderBy(*filters.contact_order("institution_name")).select(
        "institution_name", "total_pagu")


@query("priority_classes", with_packages(
    """SELECT id, CASE WHEN pagu >= 1000000000 THEN 'High' WHEN pagu >= 250000000 THEN
         CASE WHEN r <> 'Missing direct contact' THEN 'High' ELSE 'Medium' END
         WHEN pagu >= 50000000 OR r <> 'Missing direct contact' THEN 'Medium' ELSE 'Low' END
         AS priority, r AS readiness FROM (
       SELECT *, CASE id % 4 WHEN 0 THEN 'Email + phone/WhatsApp available' WHEN 1 THEN
         'Email available' WHEN 2 THEN 'Phone/WhatsApp available' ELSE 'Missing direct contact'
         END AS r FROM packages)"""))
def priority_classes(spark, sf_dir):
    key = F.col("id") % 4
    email = F.when(key.isin(0, 1), "a@b.id").otherwise("")
    phone = F.when(key.isin(0, 2), "021").otherwise("")
    ready = leads.contact_readiness(email, phone, F.lit(""))
    return packages(spark, sf_dir).select(
        "id", leads.priority(F.col("pagu"), F.lit("Dental Equipment"), ready).alias("priority"),
        ready.alias("readiness"))
