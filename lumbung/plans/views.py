"""Procurement-shaped views over the supplied tables, for Spark and, as CTEs, for the oracle.

Both sides build the same rows from the same word lists; everything grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = ["Pengadaan", "Belanja Modal", "Pemeliharaan", "Sewa", "Paket", "Instalasi",
           "Kalibrasi", "Pembelian", "Langganan", "Publikasi", "Kebutuhan"]
GOODS = ["Laptop", "Printer", "Tinta Printer", "Toner Printer", "CCTV", "Server", "Router",
         "Kamera", "Patient Monitor", "Centrifuge Tube", "Mikroskop", "Drone", "UPS",
         "Kursi Kerja", "Meja Rapat", "Kabel Fiber Optik", "Jaringan Komputer",
         "Alat Kesehatan", "Tempat Tidur Pasien", "Obat", "Tower Server",
         "Refill Toner Printer Laserjet", "Sistem Video Conference", "Gedung",
         "Alat Laboratorium", "Scanner", "Ventilator ICU", "Access Point", "Printer dan Laptop"]
UNITS = ["Dinas Pendidikan", "RSUD", "Dinas Kesehatan", "Puskesmas", "Sekretariat Daerah",
         "Universitas", "Kementerian", "Badan Nasional", "Kecamatan", "Polri", "Unit", "Bagian",
         "Rumah Sakit"]
AGENCIES = ["Kab.", "Kota", "Pemerintah Provinsi", "Kementerian", "Kabupaten"]
METHODS = ["Tender", "E-Purchasing", "Pengadaan Langsung", "Seleksi", "Penunjukan Langsung"]
KINDS = ["Barang", "Jasa Lainnya", "Pekerjaan Konstruksi"]
FUNDS = ["APBN", "APBD"]
STAGES = ["Tender Selesai", "Evaluasi Penawaran", "Pemenang Berkontrak", "Tender Batal",
          "Pengumuman Pascakualifikasi", "Masa Sanggah", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: list[str], index: Column) -> Column:
    """Word number ``index`` modulo the list length."""
    return F.get(F.array(*map(F.lit, words)), (index % len(words)).cast("int"))


def pick_sql(words: list[str], index: str) -> str:
    listed = ", ".join("'" + w + "'" for w in words)
    return f"([{listed}])[1 + CAST(({index}) % {len(words)} AS INTEGER)]"


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: agency id, name and place."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name",
        F.concat(pick(AGENCIES, F.col("n_nationkey")), F.lit(" "), "n_name").alias("kldi"),
        F.concat("r_name", F.lit(", "), "n_name").alias("lokasi"),
        F.concat(F.lit("K-"), F.col("n_nationkey").cast("string")).alias("idKldi"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning packages (14 columns), one per order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_parts = part.agg(F.count("*")).scalar()
    orders = table(spark, sf_dir, "orders").withColumn(
        "_part", F.col("o_orderkey") % n_parts)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(agencies(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("_part") == F.col("p_partkey")))
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("id"),
        F.concat(F.lit("ref-"), key.cast("string")).alias("id_referensi"),
        F.round(F.col("o_totalprice") * 2500).alias("pagu"),
        F.concat(pick(UNITS, F.col("c_custkey")), F.lit(" "), "c_name").alias("satuanKerja"),
        "kldi", "lokasi",
        pick(KINDS, key + F.col("c_custkey")).alias("jenisPengadaan"),
        pick(METHODS, F.substring("o_orderpriority", 1, 1).cast("int")).alias("metode"),
        pick(FUNDS, F.col("c_custkey")).alias("sumberDana"),
        F.concat_ws(" ", pick(ACTIONS, key), pick(GOODS, key * 7 + F.col("c_custkey")),
                    "p_name").alias("paket"),
        F.date_format("o_orderdate", "MMMM yyyy").alias("pemilihan"),
        F.month("o_orderdate").alias("idBulan"),
        F.col("c_custkey").alias("idSatker"),
        "idKldi")


def agencies_cte() -> str:
    return f"""
agencies AS MATERIALIZED (
  SELECT n_nationkey, n_name, r_name,
         {pick_sql(AGENCIES, 'n_nationkey')} || ' ' || n_name AS kldi,
         r_name || ', ' || n_name AS lokasi,
         'K-' || CAST(n_nationkey AS VARCHAR) AS "idKldi"
  FROM (SELECT n_nationkey, max(n_name) AS n_name, max(n_regionkey) AS n_regionkey
        FROM nation GROUP BY 1)
  JOIN (SELECT r_regionkey, max(r_name) AS r_name FROM region GROUP BY 1)
    ON n_regionkey = r_regionkey)"""


def packages_cte() -> str:
    return agencies_cte() + f""",
packages AS MATERIALIZED (
  SELECT o_orderkey AS id, 'ref-' || CAST(o_orderkey AS VARCHAR) AS id_referensi,
         round(o_totalprice * 2500) AS pagu,
         {pick_sql(UNITS, 'c_custkey')} || ' ' || c_name AS "satuanKerja",
         kldi, lokasi,
         {pick_sql(KINDS, 'o_orderkey + c_custkey')} AS "jenisPengadaan",
         {pick_sql(METHODS, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)")} AS metode,
         {pick_sql(FUNDS, 'c_custkey')} AS "sumberDana",
         {pick_sql(ACTIONS, 'o_orderkey')} || ' ' ||
         {pick_sql(GOODS, 'o_orderkey * 7 + c_custkey')} || ' ' || p_name AS paket,
         strftime(o_orderdate, '%B %Y') AS pemilihan,
         month(o_orderdate) AS "idBulan", c_custkey AS "idSatker", "idKldi"
  FROM (SELECT o_orderkey, any_value(o_custkey) AS o_custkey,
               any_value(o_totalprice) AS o_totalprice, any_value(o_orderdate) AS o_orderdate,
               any_value(o_orderpriority) AS o_orderpriority
        FROM orders GROUP BY 1) AS o
  JOIN (SELECT c_custkey, max(c_name) AS c_name, max(c_nationkey) AS c_nationkey
        FROM customer GROUP BY 1) ON o_custkey = c_custkey
  JOIN agencies ON c_nationkey = n_nationkey
  JOIN (SELECT p_partkey, max(p_name) AS p_name FROM part GROUP BY 1)
    ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""


def with_packages(body: str, *ctes: str) -> str:
    """A statement over the packages view and further common tables."""
    return "WITH " + ",\n".join([packages_cte(), *ctes]) + "\n" + body
