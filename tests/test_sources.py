import random

import pytest
from pyspark.sql import functions as F

from lumbung.functions import numbers, text, web
from lumbung.functions.digests import dataset_digest
from lumbung.functions.similarity import letter_counts, ratio, upper_bound
from lumbung.operators import products, registry
from lumbung.sources import contacts, evidence, html, packages, sinks

DETAIL = """<table><tr><th>Informasi</th></tr>
<tr><td>Kode Tender</td><td>123</td></tr>
<tr><td>Rencana Umum Pengadaan</td><td><table><tr><th>Kode RUP</th><th>Nama Paket</th>
<th>Sumber Dana</th></tr><tr><td>55</td><td>Paket A</td><td>APBD</td></tr>{more}</table></td></tr>
<tr><td>Tahap Tender Saat Ini</td><td>Selesai</td></tr>
<tr><td>K/L/PD/Instansi Lainnya</td><td>Kota A</td><td>Satuan Kerja</td><td>Dinas B</td></tr>
<tr><td>Kode Paket</td><td>later</td></tr></table>"""


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_nested_tables_and_detail_fields(spark):
    pages = spark.createDataFrame([
        ("one", DETAIL.format(more="")),
        ("two", DETAIL.format(more="<tr><td>56</td><td>Paket B</td></tr>")),
        ("none", "<p>no tables</p>")], "page_id string, html string")
    rows = html.html_tables(pages)
    got = {r.page_id: r for r in html.detail_fields(rows).collect()}
    one = got["one"]
    assert (one.package_code, one.kode_rup, one.stage_or_status, one.institution_name,
            one.satker) == ("123", "55", "Selesai", "Kota A", "Dinas B")
    assert got["two"].kode_rup == ""
    assert [(r.kode_rup, r.sumber_dana) for r in got["two"].kode_rup_rows] == [
        ("55", "APBD"), ("56", "")]
    assert "none" not in got
    snippets = {r.page_id: r.snippet for r in html.table_snippets(rows).collect()}
    assert snippets["two"] == "55 | Paket A | APBD || 56 | Paket B"


def test_whole_pages_give_the_same_as_their_rows(spark):
    pages = spark.createDataFrame([
        ("one", DETAIL.format(more="")), ("head", "<table><tr><td>Kode RUP</td></tr></table>"),
        ("two", DETAIL.format(more="<tr><td>56</td><td>Paket B &amp; C</td></tr>")),
        ("null", None), ("none", "<p>no tables</p>")], "page_id string, html string")
    rows, parsed = html.html_tables(pages), html.parsed_pages(pages)
    for by_rows, whole in ((html.detail_fields(rows), html.page_details(parsed)),
                           (html.table_snippets(rows), html.page_snippets(parsed)),
                           (evidence.table_evidence(rows),
                            evidence.table_evidence(html.page_tables(parsed)))):
        names = by_rows.columns
        assert sorted(whole.select(names).collect()) == sorted(by_rows.collect())
        assert by_rows.count() > 0
    plan = html.page_details(parsed)._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # the page is parsed once and nothing moves


def test_tables_without_a_tree_are_those_of_the_tree():
    rng = random.Random(7)
    plain = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<TH>", "</th>", "<b>",
             "</b>", "<br>", '<td class="a b">', "</p>", "none", " nan ", "a b", "x\u00a0", "> "]
    odd = ["&amp;", "<!-- c -->", "<script>", "</script>", "<br/>", "< ", "<td a=b>", "<a",
           "</td x=\"1\">"]
    passed = 0
    for _ in range(4000):
        page = "".join(rng.choice(plain if rng.random() < .99 else odd)
                       for _ in range(rng.randint(0, 40)))
        assert html.tables_of(page) == html._parsed_tables(page), page
        passed += html._plain_tables(page) is not None
    assert passed > 2500


def test_ragged_rows_are_padded(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</td></tr><tr><td>1</td><td>2<br>3</td>"
                                       "</tr><tr><td></td></tr></table>")],
                                  "page_id int, html string")
    row = html.html_tables(pages).first()
    assert (row.headers, row.cells) == (["a", "column_2"], ["1", "2 3"])


def test_columns_by_synonym(spark):
    page = "<table><tr><th>No</th><th>Nama Paket</th><th>Instansi</th><th>Tahun</th></tr>" \
           "<tr><td>7</td><td>Server</td><td>X</td><td>2026</td></tr>" \
           "<tr><td>8</td><td>Old</td><td>X</td><td>2024</td></tr></table>"
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = evidence.table_evidence(html.html_tables(pages, min_rows=2), 2026).collect()
    assert [(r.package_code, r.package_name, r.institution_name) for r in rows] == [
        ("7", "Server", "X")]


def test_links_by_section(spark):
    page = '<a href="/jadwal">Jadwal</a><a href="/jadwal">again</a><a href="x">Kontrak</a>' \
           '<a href="/other">other</a><a>text only</a>'
    pages = spark.createDataFrame([(1, "https://h.id/p/", page)],
                                  "page_id int, url string, html string")
    rows = html.page_links(html.html_anchors(pages)).collect()
    assert {(r.section, r.absolute) for r in rows} == {
        ("schedule", "https://h.id/jadwal"), ("contract", "https://h.id/p/x")}


def test_registry_cards_and_details(spark):
    card = """<div class="card card-small-round"><h4>LPSE Kota Aceh</h4>
    <span class="badge">3 Online</span><div class="form-group row">
    <label class="col-form-label light">Provinsi</label><p class="form-row-content">Aceh</p></div>
    <div class="form-group row"><label class="col-form-label light">Versi SPSE</label>
    <p class="form-row-content">v4.5</p></div><a href="/d/1">Detail LPSE</a>
    <a href="http://lpse.id/">Ke Halaman Web LPSE</a></div>"""
    pages = spark.createDataFrame([("https://r.id/index", 1, None, card)],
                                  "page_url string, page_number int, filter_province string, "
                                  "html string")
    rows = html.registry_cards(pages, F.lit("now"))
    row = rows.first()
    assert (row.nama_lpse, row.kategori_instansi, row.provinsi, row.versi_spse, row.aktif,
            row.https, row.domain, row.source_page) == (
        "LPSE Kota Aceh", "Pemerintah Kota", "Aceh", "v4.5", True, False, "lpse.id",
        "https://r.id/d/1")
    detail = spark.createDataFrame([("https://r.id/d/1", """<div class="col-sm-10">
    <label class="col-form-label light">URL</label><p class="form-row-content">https://new.id/x
    </p></div>""")], "source_page string, html string")
    fresh = registry.with_details(rows.drop("card_idx"), html.registry_details(detail)).first()
    assert (fresh.official_lpse_url, fresh.domain, fresh.https, fresh.provinsi) == (
        "https://new.id/x", "new.id", True, "Aceh")


def test_amounts(spark):
    df = col(spark, ["Rp 604.650.000", "891,2 juta", "1.234,5", "2 miliar", "3 M", "", "x"])
    assert values(df, numbers.parse_budget(F.col("v"))) == [
        604650000.0, 891200000.0, 1234.5, 2e9, 3.0, None, None]
    assert values(df, numbers.parse_budget(F.col("v"), m_is_billion=True))[4] == 3e9
    assert values(df, numbers.parse_budget(F.col("v"), legacy=True))[0] == 604650.0
    plain = col(spark, ["1.234.567", "1.234,5", "12,5", "n/a"])
    assert values(plain, numbers.parse_plain_budget(F.col("v"))) == [1234567.0, 1234.5, 12.5,
                                                                     None]


def test_small_text_functions(spark):
    df = col(spark, ["Mei 2026", "07", "December", "none"])
    assert values(df, text.month_number(F.col("v"))) == [5, 7, 12, None]
    names = col(spark, ["LPSE  kab. Halmahera  tengah", "Kota. X", "KOTA Y"])
    assert values(names, text.organisation_name(F.col("v"))) == [
        "Kabupaten Halmahera Tengah", "Kota X", "Kota Y"]
    urls = col(spark, ["https://Ex.id/a#b", "https://u:p@ex.id", "http://ex.id", "https://ex.id",
                       "x"])
    assert values(urls, web.https_url(F.col("v"))) == ["https://ex.id/a", None, None,
                                                       "https://ex.id/", None]
    assert values(urls, web.has_web_provenance(F.col("v"))) == [True, True, True, True, False]
    portal = col(spark, ["https://spse.inaproc.id/aceh/x", "https://spse.inaproc.id/nasional",
                         "https://other.id/a"])
    assert values(portal, web.portal_slug(F.col("v"))) == ["aceh", None, None]
    versions = col(spark, ["SPSE v4.5.1", "Portal eProc 3", "none"])
    assert values(versions, registry.software_version(F.col("v"))) == ["v4.5.1", "v3", None]


def test_mapping_scores_and_display(spark):
    from lumbung.operators import linkage

    df = spark.createDataFrame([("Dinas X", "Kota Y", "kota y", "Pengadaan Laptop",
                                 "Belanja Laptop", "Tender")],
                               "unit string, kldi string, e string, n string, en string, "
                               "st string")
    score = linkage.institution_score([F.col("unit"), F.col("kldi")], F.col("e"))
    name = linkage.name_score(F.col("n"), F.col("en"), F.col("st"))
    row = df.select(score.alias("s"), name.alias("n"), numbers.rupiah(F.lit(1234567)).alias(
        "r"), text.month_label(F.to_date(F.lit("2026-05-01"))).alias("m"),
        linkage.same_year(F.lit(2026), F.lit(None).cast("int")).alias("y")).first()
    assert tuple(row) == (1.0, 1.0, "Rp\u00a01.234.567", "May 2026", False)


def test_institution_ids(spark):
    def expected(name):
        h = 0
        for unit in memoryview(name.encode("utf-16-le")).cast("H"):
            h = (h * 31 + unit) % 2**32
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    names = ["Dinas Pendidikan", "Café Été", "𝒳 Data", "---"]
    got = values(col(spark, names), web.institution_id(F.col("v")))
    assert [g.rsplit("-", 1)[1] for g in got] == [expected(n) for n in names]
    assert got[1].startswith("cafe-ete-") and got[3].startswith("institution-")


def test_similarity_bound_never_cuts_a_match():
    words = ["pengadaan server", "server pengadaan", "laptop", "laptob dinas", "a", "zz top", ""]
    bound = upper_bound(letter_counts(words), letter_counts(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert ratio(a, b) <= bound[i, j] + 1e-12


CRAWLER = "institution,kldi,website,email,phone,whatsapp,source_url,confidence_score\n"


def test_contact_files(spark, tmp_path):
    name = "contact-qwen-master-clean.csv"
    for folder, body in (("a", "Dinas X,Kota Y,,x@y.id,,,https://y.id,high\n"),
                         ("b", "Dinas X,Kota Y,,x@y.id,,,https://y.id,high\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("﻿" + CRAWLER + body, encoding="utf-8")
    paths = [str(tmp_path / f / name) for f in ("a", "b")]
    rows = contacts.read_contacts(spark, paths).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.institution_display_name, row.source_confidence, row.completeness_score) == (
        "Dinas X — Kota Y", 0.9, 4 + 4 + 1 + 0.9)
    assert row.match_keys["work_unit_parent"] == "dinas x || kota y"
    (tmp_path / "b" / name).write_text(CRAWLER + "Other,,,,,,,\n")
    with pytest.raises(ValueError, match="conflict"):
        contacts.read_contacts(spark, paths)
    (tmp_path / "a" / name).write_text("institution\nx\n")
    with pytest.raises(ValueError, match="missing required columns"):
        contacts.read_contact_file(spark, paths[0])
    with pytest.raises(ValueError, match="unknown contact source"):
        contacts.read_contacts(spark, [str(tmp_path / "other.csv")])


def test_evidence_files_by_name_and_content(spark, tmp_path):
    (tmp_path / "spse_export.csv").write_text("a\n1\n")
    (tmp_path / "notes.csv").write_text("a\nTender selesai\n")
    (tmp_path / "contact_list.csv").write_text("a\nTender selesai\n")
    (tmp_path / "spse.bin").write_text("x")
    named = evidence.evidence_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in named] == ["spse_export.csv"]
    scanned = evidence.evidence_files(spark, str(tmp_path), scan_content=True).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in scanned) == ["notes.csv", "spse_export.csv"]


def test_unknown_headers(spark):
    df = spark.createDataFrame([("9", "Paket X", "Tender batal", "1.500,5")],
                               "`Kode RUP` string, `Nama Paket` string, `Tahapan` string, "
                               "`Nilai Pagu` string")
    row = evidence.evidence_from_table(df, "spse.csv", F.lit(2)).first()
    assert (row.rup_id, row.package_name, row.matched_text, row.budget_value,
            row.factual_status, row.source_record_id) == (
        "9", "Paket X", "Tender batal", 1500.5, "FOUND_CANCELLED_OR_FAILED", "spse.csv#2")


def test_packages_and_candidates(spark, tmp_path):
    rows = [(20, "ref-20", 12.5, "Unit B", "KLDI B", "Jakarta", "Barang", "Tender", "APBN",
             "Package B", "March", 3, 9001, "  K-02  "),
            (10, "ref-10", 7.25, "Unit A", "KLDI A", "Bandung", "Jasa", "Seleksi", "APBD",
             "Package A", "April", 4, 42, "K-01")]
    df = spark.createDataFrame(rows, packages.PACKAGES)
    sinks.write_parquet(df, str(tmp_path / "p"))
    back = packages.read_packages(spark, str(tmp_path / "p"))
    got = packages.plan_candidates(back, 2026, F.lit("prov")).collect()
    assert [(r.planned_procurement_id, str(r.budget), r.id_kldi) for r in got] == [
        ("10", "7.25", "K-01"), ("20", "12.50", "  K-02  ")]
    with pytest.raises(ValueError):
        packages.plan_candidates(back, 2026, F.lit("p"), limit=0)
    bad = df.withColumn("kldi", F.when(F.col("id") == 10, F.col("kldi")))
    assert packages.unusable_packages(bad).first().missing == ["kldi"]
    with pytest.raises(Exception, match="missing required fields"):
        packages.require_usable(bad).collect()


def test_sidecars_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    digest = sinks.write_sidecar(df, str(tmp_path / "s"), ["k"])
    assert digest == dataset_digest(df.orderBy("k").repartition(3), ["k", "v"]).first()["digest"]
    lines = [r.value for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sorted(lines) == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']
    path = str(tmp_path / "artifact")
    meta = sinks.write_artifact(df, path, "registry:csv")
    assert sinks.load_artifact(spark, path, "registry:csv")[1] == meta
    sinks.write_parquet(df.where("k = 1"), f"{path}/table")
    with pytest.raises(ValueError, match="does not match"):
        sinks.load_artifact(spark, path, "registry:csv")


def test_keywords_are_found_anywhere(spark):
    texts = {1: "kamera video dan printer a4", 2: "kursi", 3: "", 4: "kamerad xprinter aé4é"}
    words = ["kamera", "video", "printer", "a4", "kursi", "zzz", "print", "é", "4é", "a"]
    rows = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = products.keyword_hits(rows, "id", "t", col(spark, words).withColumnRenamed(
        "v", "keyword"))
    assert sorted(map(tuple, got.collect())) == sorted(
        (i, w) for i, t in texts.items() for w in words if w in t)


def test_stored_products_replace_the_seed(spark):
    seed = products.seed_products(spark)
    assert products.product_data_set(seed.limit(0), seed).count() == 10
    chosen = products.product_data_set(seed.where("id = 'ups-general'"), seed)
    assert [(r.id, r.using_seed_fallback) for r in chosen.collect()] == [("ups-general", False)]


def test_few_and_many_keywords_hit_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a laptop and a server"), (2, "srv"), (3, None), (4, "")],
                                 "id int, t string")
    words = col(spark, ["laptop", "serv", "srv", "a", "", None, "xyz"]).withColumnRenamed(
        "v", "keyword")
    few = products.keyword_hits(rows, "id", "t", words)
    assert "NestedLoop" in few._jdf.queryExecution().toString()
    monkeypatch.setattr(products, "FEW_KEYWORDS", 2)
    many = products.keyword_hits(rows, "id", "t", words)
    assert sorted(few.collect()) == sorted(many.collect()) == [
        (1, "a"), (1, "laptop"), (1, "serv"), (2, "srv")]
