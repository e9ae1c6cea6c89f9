"""Quoted delimited files in byte ranges, and evidence files of unknown layout."""

import csv
import io
import random

import pytest

from lumbung.sources import delimited, evidence


@pytest.mark.parametrize("size", [97, 400, 1 << 20])
def test_records_of_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for f in range(3):
        rows = [["id", "text"]] + [[str(i), rng.choice([
            "plain", 'with "quotes"', "line\nbreak", "a,b", 'x\n"\n"\ny', "", "\n\n\n", "é" * 30])]
            for i in range(120)]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        text = ("﻿" if f == 1 else "") + out.getvalue().replace("\n60,", "\n\n\n60,")
        (tmp_path / f"t{f}.csv").write_bytes(text.encode())
        want[f"t{f}.csv"] = rows
    (tmp_path / "empty.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = delimited.records(spark, str(tmp_path))
        if size == 97:
            assert delimited._lines(spark, str(tmp_path)).select(
                "path", "start").distinct().count() >= 12
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r.path, r.record)):
            found.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.record, r.text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert set(found) == set(want)
    for name, rows in want.items():
        assert [n for n, _ in found[name]] == list(range(len(rows)))
        assert [next(csv.reader(io.StringIO(t, newline=""))) for _, t in found[name]] == rows


def test_unclosed_quote_is_the_last_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,k\n1,"open\n2,x\n3,y\n')
    got = delimited.records(spark, str(tmp_path)).orderBy("record").collect()
    assert [r.text for r in got] == ["h,k", '1,"open\n2,x\n3,y']


def test_load_evidence(spark, tmp_path):
    files = {
        "spse_one.csv": 'nama_paket,status,id_rup,pagu\n"Server, ""besar""",Tender selesai,11,'
                        '"1000"\nLaptop,,12,5\n"Kursi\ndan meja",evaluasi penawaran,13,7\n',
        "spse_two.csv": "nama_paket,status,id_rup,pagu\nMeja,pemenang berkontrak,21,9\n",
        "spse_other.csv": "tahapan,tahun,link\nTender selesai,2026,https://x.id/1\nnothing,1,2\n",
        "spse_third.csv": "kldi,keterangan\nDinas A,tender batal\n",
        "spse_broken.csv": "nama_paket,status\nA,tender selesai\nB,tender selesai,extra,more\n",
        "spse_open.csv": 'nama_paket,status\nA,"tender selesai\n',
        "spse_empty.csv": "\n\n",
        "spse_page.html": "<p>Tender selesai</p>",
        "spse_list.json": '{"status": "pemenang berkontrak"}',
        "notes.txt": "tender selesai",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, report = evidence.load_evidence(spark, str(tmp_path))
    got = {r.source_record_id: r for r in rows.collect() if r.source_record_id}
    assert set(got) == {"spse_one.csv#2", "spse_one.csv#4", "spse_two.csv#2", "spse_other.csv#2",
                        "spse_third.csv#2"}
    assert got["spse_one.csv#2"].package_name == 'Server, "besar"'
    assert (got["spse_one.csv#4"].rup_id, got["spse_one.csv#4"].budget_value) == ("13", 7.0)
    assert got["spse_other.csv#2"].url_or_reference == "https://x.id/1"
    assert got["spse_third.csv#2"].institution_name == "Dinas A"
    state = {r.file: (r.scan_status, r.evidence_rows_found, r.used_for_matching)
             for r in report.collect()}
    assert state == {
        "spse_one.csv": ("scanned_csv", 2, "yes"), "spse_two.csv": ("scanned_csv", 1, "yes"),
        "spse_other.csv": ("scanned_csv", 1, "yes"), "spse_third.csv": ("scanned_csv", 1, "yes"),
        "spse_broken.csv": ("error: more fields than the header", 0, "no"),
        "spse_open.csv": ("error: quote is not closed", 0, "no"),
        "spse_empty.csv": ("error: no header", 0, "no"),
        "spse_page.html": ("scanned_text", 1, "yes"), "spse_list.json": ("scanned_text", 1, "yes")}
