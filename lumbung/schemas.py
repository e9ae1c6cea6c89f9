"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in
                         (item.split(":") for item in spec.split())])


PACKAGES = _fields("id:l id_referensi:s pagu:d satuanKerja:s kldi:s lokasi:s jenisPengadaan:s "
                   "metode:s sumberDana:s paket:s pemilihan:s idBulan:i idSatker:l idKldi:s")

PAGES = _fields("run_id:s page_start:l requested_length:l page_draw:l payload:s")

EVIDENCE = _fields("source_url:s source_type:s package_code:s package_name:s institution_name:s "
                   "stage_or_status:s hps_or_pagu:s fiscal_year:s collected_at:s "
                   "evidence_level:s raw_file_path:s")

REGISTRY_COLUMNS = ["nama_lpse", "instansi", "kategori_instansi", "provinsi", "kabupaten_kota",
                    "official_lpse_url", "domain", "https", "aktif", "dapat_diakses",
                    "menggunakan_spse", "versi_spse", "portal_induk", "tanggal_pengecekan",
                    "source_url", "source_page", "source_page_number", "source_filter_provinsi",
                    "source_note"]
