"""Sources and sinks: views of the tables are written to a fresh folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumbung.functions.digests import dataset_digest
from lumbung.plans.registry import query
from lumbung.plans.views import UNITS, packages, pick, pick_sql, table, with_packages
from lumbung.session import checkpoint_root
from lumbung.sources import contacts, delimited, evidence, html, sinks
from lumbung.sources import packages as package_source

QUOTED = 'with "quotes", commas; and\ttabs'


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("plan_candidates", with_packages("""
 SELECT CAST(id AS VARCHAR) AS planned_procurement_id, CAST("idSatker" AS VARCHAR) AS id_satker,
  kldi AS kldi_name, paket AS package_title, CAST(pagu AS DOUBLE) AS budget, 2026 AS source_year
 FROM packages"""))
def plan_candidates(spark, sf_dir):
    """Packages stored as Parquet and read again under their schema."""
    folder = fresh_folder(spark, "packages")
    sinks.write_parquet(packages(spark, sf_dir), folder)
    rows = package_source.plan_candidates(package_source.read_packages(spark, folder), 2026,
                                          F.lit("test"))
    return rows.select("planned_procurement_id", "id_satker", "kldi_name", "package_title",
                       F.col("budget").cast("double").alias("budget"), "source_year")


@query("csv_round_trip", f"""
 SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' {QUOTED}' AS c_name,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def csv_round_trip(spark, sf_dir):
    """Text with separators and quotes survives a delimited file."""
    folder = fresh_folder(spark, "csv")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(f" {QUOTED}")).alias("c_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    sinks.write_csv(rows, folder)
    return spark.read.option("header", True).option("escape", '"').csv(folder)


@query("sidecar_rows", """
 SELECT s_suppkey, s_name, TRUE AS in_order, TRUE AS same_digest FROM supplier""")
def sidecar_rows(spark, sf_dir):
    """Sorted JSON lines: files follow each other in order, and the digest is the table's."""
    folder = fresh_folder(spark, "sidecar")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    digest = sinks.write_sidecar(rows, folder, ["s_suppkey"])
    same = dataset_digest(rows, ["s_name", "s_suppkey"]).first()["digest"] == digest
    lines = spark.read.text(folder).select(
        F.from_json("value", "s_suppkey long, s_name string").alias("r"),
        F.col("_metadata.file_name").alias("file"))
    files = lines.groupBy("file").agg(F.min("r.s_suppkey").alias("low"),
                                      F.max("r.s_suppkey").alias("high"))
    # Part files are named in write order; there are as many rows here as files.
    spans = sorted((r["file"], r["low"], r["high"]) for r in files.collect())
    ordered = all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))
    return lines.select("r.*", F.lit(ordered).alias("in_order"), F.lit(same).alias("same_digest"))


@query("artifact_rows", """
 SELECT n_nationkey, n_name, 'registry' AS artifact, TRUE AS refused_when_changed FROM nation""")
def artifact_rows(spark, sf_dir):
    """A table bound to its metadata; the same metadata over other rows is refused."""
    return bound_rows(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
                      "n_nationkey > 0")


@query("artifact_orders", """
 SELECT o_orderkey, o_custkey, 'registry' AS artifact, TRUE AS refused_when_changed FROM orders""")
def artifact_orders(spark, sf_dir):
    """The same for a table that grows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return bound_rows(spark, rows, "o_orderkey % 1000 <> 1")


def bound_rows(spark, rows, others):
    """``rows`` written and loaded as an artifact, which is refused with the rows of ``others``."""
    folder = fresh_folder(spark, "artifact")
    sinks.write_artifact(rows, folder, "registry")
    loaded, meta = sinks.load_artifact(spark, folder, "registry")
    sinks.write_parquet(rows.where(others), f"{folder}/other/table")
    spark.read.json(f"{folder}/metadata").write.json(f"{folder}/other/metadata")
    try:
        sinks.load_artifact(spark, f"{folder}/other", "registry")
        refused = False
    except ValueError:
        refused = True
    return loaded.select(*rows.columns, F.lit(meta["registry_artifact_id"]).alias("artifact"),
                         F.lit(refused).alias("refused_when_changed"))


CONFIDENCE = ["high", "0.25", "weak", ""]


@query("contact_layout", f"""
 SELECT CAST(s_suppkey AS VARCHAR) AS contact_person, {pick_sql(UNITS, 's_suppkey')} ||
   CASE WHEN s_suppkey % 4 <> 0 THEN ' — K' || (s_suppkey % 4) ELSE '' END
   AS institution_display_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'p' ELSE 'o' END || s_suppkey || '@x.id' AS contact_email,
  CAST([0.9, 0.25, 0.5, 0.0][1 + s_suppkey % 4] AS DOUBLE) AS source_confidence,
  CAST(7.0 + CASE WHEN s_suppkey % 2 = 0 THEN 2.0 ELSE 0.0 END + [0.9, 0.25, 0.5, 0.0][1 +
   s_suppkey % 4] AS DOUBLE) AS completeness_score FROM supplier""")
def contact_layout(spark, sf_dir):
    """A contact file of a known layout, as canonical contacts."""
    k = F.col("s_suppkey")
    name = "verified_cache_contacts_1640.csv"
    folder = f"{fresh_folder(spark, 'contacts')}/{name}"
    given = {
        "institution_name": pick(UNITS, k), "cache_institution": F.lit(""),
        "cache_kldi": F.when(k % 4 != 0, F.concat(F.lit("K"), (k % 4).cast("string"))),
        "official_email": F.when(k % 3 != 0, F.concat(F.lit("o"), k.cast("string"), F.lit(
            "@x.id"))),
        "procurement_email": F.concat(F.lit("p"), k.cast("string"), F.lit("@x.id")),
        "phone": F.when(k % 2 == 0, "021"), "whatsapp": F.lit(None).cast("string"),
        "source_url": F.lit("https://x.id/contact"), "confidence_score": pick(CONFIDENCE, k),
        "verified_level": F.lit("a"), "match_status": F.lit("b"), "audit_status": F.lit("c"),
        "institution_type": F.lit("d"), "pic_name": k.cast("string")}
    sinks.write_csv(table(spark, sf_dir, "supplier").select(
        *[c.alias(n) for n, c in given.items()]), folder)
    rows = contacts.canonical_contacts(contacts.read_contact_file(spark, folder), name, F.lit(0))
    return rows.select("contact_person", "institution_display_name", "contact_email",
                       "source_confidence", "completeness_score")


@query("evidence_layouts", """
 SELECT CAST(o_orderkey AS VARCHAR) AS package_code, CAST(2020 + o_orderkey % 7 AS INT)
  AS fiscal_year, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 900 + 1) * 1e6 ELSE
  (o_orderkey % 90 + 1) * 1e9 END AS budget_value,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Tender' END AS method FROM orders""")
def evidence_layouts(spark, sf_dir):
    """Evidence files with different columns, put together with numbers from their texts."""
    folder, k = fresh_folder(spark, "evidence"), F.col("o_orderkey")
    year = F.concat(F.lit("TA "), (2020 + k % 7).cast("string"))
    rows = table(spark, sf_dir, "orders")
    even = rows.where(k % 2 == 0).select(
        k.cast("string").alias("package_code"), year.alias("fiscal_year"),
        F.concat((k % 900 + 1).cast("string"), F.lit(" juta")).alias("hps_or_pagu"),
        F.lit("Tender").alias("method"))
    odd = rows.where(k % 2 != 0).select(
        k.cast("string").alias("package_code"), year.alias("fiscal_year"),
        F.concat(F.lit("Rp "), (k % 90 + 1).cast("string"), F.lit(" Miliar")).alias(
            "hps_or_pagu"))
    for name, part in (("even", even), ("odd", odd)):
        sinks.write_csv(part, f"{folder}/{name}")
    return evidence.read_evidence(spark, [f"{folder}/even", f"{folder}/odd"]).select(
        "package_code", "fiscal_year", "budget_value", "method")


@query("registry_cards", """
 SELECT 'LPSE Kota ' || s_name AS nama_lpse, 'Pemerintah Kota' AS kategori_instansi,
  'Aceh' AS provinsi, 'v4.' || (s_suppkey % 6) AS versi_spse, s_suppkey % 3 > 0 AS aktif,
  s_suppkey % 2 = 0 AS https, 'lpse' || s_suppkey || '.id' AS domain,
  'https://r.id/d/' || s_suppkey AS source_page FROM supplier""")
def registry_cards(spark, sf_dir):
    """Ten registry cards per stored index page."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    card = F.concat(
        F.lit('<div class="card card-small-round"><h4>LPSE Kota '), "s_name",
        F.lit('</h4><span class="badge">3 '), F.when(k % 3 > 0, "Online").otherwise("Offline"),
        F.lit('</span><div class="form-group row"><label class="col-form-label light">Provinsi'
              '</label><p class="form-row-content">Aceh</p></div><div class="form-group row">'
              '<label class="col-form-label light">Versi SPSE</label>'
              '<p class="form-row-content">v4.'), (k % 6).cast("string"),
        F.lit('</p></div><a href="/d/'), text, F.lit('">Detail LPSE</a><a href="'),
        F.when(k % 2 == 0, "https").otherwise("http"), F.lit("://lpse"), text,
        F.lit('.id/">Ke Halaman Web LPSE</a></div>'))
    pages = table(spark, sf_dir, "supplier").groupBy(F.floor(k / 10).cast("int").alias(
        "page_number")).agg(F.array_join(F.collect_list(card), "").alias("html"))  # ten cards
    rows = html.registry_cards(pages.select(
        F.lit("https://r.id/index").alias("page_url"), "page_number",
        F.lit(None).cast("string").alias("filter_province"), "html"), F.lit("now"))
    return rows.select("nama_lpse", "kategori_instansi", "provinsi", "versi_spse", "aktif",
                       "https", "domain", "source_page")


def _csv(rows, folder, name):
    """One more layout among the files of ``folder``."""
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(f"{folder}/{name}")


@query("csv_records", """
 SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '",' || chr(10) AS remark,
  TRUE AS numbered FROM customer""")
def csv_records(spark, sf_dir):
    """Line breaks and quotes inside quotes; the records of every file are numbered without gap."""
    folder = fresh_folder(spark, "records")
    _csv(table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        "c_name", F.lit('\n"'), "c_mktsegment", F.lit('",\n')).alias("remark")).repartition(
        3, "c_custkey"), folder, "csv")
    rows = delimited.parsed(delimited.records(spark, folder).where("record > 0"),
                            ["c_custkey", "remark"])
    ends = rows.groupBy("_path").agg((F.max("_record") == F.count_distinct("_record")).alias(
        "numbered"))
    return rows.join(ends, "_path").select(F.col("c_custkey").cast("long").alias("c_custkey"),
                                           "remark", "numbered")


def evidence_folder(spark, sf_dir):
    """Suppliers as evidence files of two layouts, a file with a wrong row and a page."""
    folder = fresh_folder(spark, "evidence")
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.concat(F.col("s_name"), F.lit(', "unit"\nof '), F.col(
            "s_nationkey").cast("string")).alias("place"),
        F.when(k % 3 == 0, "Tender Selesai").when(k % 3 == 1, "Pengumuman Pemenang").otherwise(
            "").alias("state"))
    _csv(rows.where(k % 2 == 0).select(F.col("s_suppkey").alias("id_rup"), F.col("s_name").alias(
        "nama_paket"), F.col("place").alias("instansi"), F.col("state").alias("status")),
        folder, "first")
    _csv(rows.where(k % 2 == 1).select(F.col("state").alias("tahapan"), F.col("place").alias(
        "satker"), F.col("s_suppkey").alias("kode_rup")), folder, "second")
    rows.limit(1).select(F.lit("tender selesai,2,3").alias("status")).write.option(
        "header", True).option("quote", "").csv(f"{folder}/wrong")
    return folder


@query("evidence_folder_rows", """
 SELECT CAST(s_suppkey AS VARCHAR) AS rup_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END
  AS package_name, s_name || ', "unit"' || chr(10) || 'of ' || s_nationkey AS institution_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Tender Selesai' ELSE 'Pengumuman Pemenang' END AS matched_text
 FROM supplier WHERE s_suppkey % 3 <> 2""")
def evidence_folder_rows(spark, sf_dir):
    """Evidence of a folder whose files have different headers."""
    rows, _ = evidence.load_evidence(spark, evidence_folder(spark, sf_dir))
    return rows.select("rup_id", "package_name", "institution_name", "matched_text")
