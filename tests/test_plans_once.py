"""Costly text rules stand once in a plan, so they run once for each row."""

from pyspark.sql import functions as F

from lumbung.operators import leads, outreach

PACKAGE = "id long, paket string, satuanKerja string, kldi string, lokasi string, " \
    "jenisPengadaan string, pagu double, pemilihan string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(spark, tmp_path):
    spark.createDataFrame([
        (1, "Laptop kantor", "Dinas", "Kota", "A, B", "Barang", 1.0, "May 2026"),
        (2, "Obat laptop", "RSUD", "Kota", "A, B", "Barang", 2.0, "May 2026"),
        (3, "Ventilator", "RSUD", "Kota", "A, B", None, 3.0, None),
        (4, None, None, None, None, None, None, None)], PACKAGE).write.parquet(f"{tmp_path}/p")
    return spark.read.parquet(f"{tmp_path}/p")


def test_packages_are_classified_once(spark, tmp_path):
    relevant = outreach.relevant_packages(rows(spark, tmp_path))
    steps = [line for line in plan(relevant.select("id", "categories")).splitlines()
             if "bmhp" in line]
    assert len(steps) == 1 and "Generate" in steps[0]
    assert [(r.id, r.categories) for r in relevant.collect()] == [(1, ["LAPTOP"])]
    assert "bmhp" not in plan(outreach.institution_rollup(rows(spark, tmp_path / "again")))


def test_lead_texts_are_made_once(spark, tmp_path):
    found = rows(spark, tmp_path).where(leads.is_health_lead())
    assert plan(found.select("id")).count("concat_ws") == 1
    assert found.agg(F.count("*")).first()[0] in (1, 2)
