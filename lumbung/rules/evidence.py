"""Execution-evidence vocabulary: status terms, source hints, column synonyms, detail labels."""

# ---- fixed values ---------------------------------------------------------------------------
STATUS_TERMS = [
    "tender", "non tender", "non-tender", "pengadaan langsung", "e-purchasing", "katalog",
    "epurchasing", "pemenang", "pemenang berkontrak", "kontrak", "selesai", "gagal", "batal",
    "dibatalkan", "evaluasi", "pengumuman", "sanggah", "tanda tangan kontrak",
]

# Observed status from free text, first class wins.
FACTUAL_STATUS = {
    "FOUND_CANCELLED_OR_FAILED": ["batal", "dibatalkan", "gagal"],
    "FOUND_CONTRACT": ["pemenang berkontrak", "tanda tangan kontrak", "berkontrak", "kontrak"],
    "FOUND_COMPLETED": ["selesai"],
    "FOUND_WINNER": ["pemenang"],
    "FOUND_E_PURCHASING_PROCESS": ["e-purchasing", "epurchasing", "katalog", "e katalog",
                                   "e-katalog"],
    "FOUND_NON_TENDER_PROCESS": ["non tender", "non-tender", "pengadaan langsung"],
    "FOUND_TENDER_PROCESS": ["tender", "evaluasi", "pengumuman", "sanggah"],
}

# Status of a matched candidate on its normalised source status, first class wins.
PROCUREMENT_STATUS = {
    "CANCELLED_OR_FAILED": ["batal", "gagal"],
    "COMPLETED": ["selesai"],
    "CONTRACTED": ["kontrak", "berkontrak"],
    "WINNER_SELECTED": ["pemenang"],
    "IN_PROCESS": ["tender", "evaluasi", "pengumuman", "sanggah"],
}
PROCUREMENT_STATUS_OTHER = "OBSERVED_OTHER"
PLANNING_ONLY = "SIRUP_PLANNING_ONLY"

SOURCE_TYPES = {
    "LPSE_LOCAL_EXPORT": ["lpse"],
    "SPSE_LOCAL_EXPORT": ["spse"],
    "E_PURCHASING_OR_KATALOG_LOCAL_EXPORT": ["e-purchasing", "epurchasing", "katalog",
                                             "e katalog", "e-katalog"],
    "PROCUREMENT_STATUS_LOCAL_EXPORT": ["pemenang", "kontrak", "tender", "sanggah",
                                        "pengumuman"],
}
SOURCE_TYPE_DEFAULT = "LOCAL_FILE"

REAL_SOURCE_HINTS = ["spse", "lpse", "tender", "non_tender", "non-tender", "epurchasing",
                     "e-purchasing", "katalog", "pemenang", "kontrak", "berkontrak",
                     "pengumuman", "sanggah"]
DERIVED_SOURCE_HINTS = ["sirup_", "institution_opportunities", "opportunities", "scored",
                        "contact", "contacts", "sendable", "outreach", "sirup_leads",
                        "master_institutions", "sales_fit"]
EVIDENCE_EXTENSIONS = [".csv", ".html", ".htm", ".json"]

# Logical column -> accepted header synonyms in order of preference.
GENERIC_COLUMNS = {
    "rup_id": ["rup_id", "id_rup", "id", "kode_rup"],
    "package_id": ["package_id", "paket_id", "id_paket", "id_referensi"],
    "package_name": ["package_name", "nama_paket", "paket", "nama tender", "tender",
                     "procurement_description"],
    "institution_name": ["institution_name", "satuanKerja", "satker", "unit_kerja", "kldi",
                         "instansi", "agency"],
    "budget": ["budget_value", "budget", "pagu", "nilai", "nilai_pagu", "hps"],
    "year": ["source_year", "fiscal_year", "tahun", "year"],
    "url": ["url", "source_url", "link", "source_url_or_reference", "reference"],
    "status": ["status", "factual_status", "tahapan", "hasil", "keterangan"],
}

TABLE_COLUMNS = {
    "package_code": ["kode tender", "kode paket", "kode", "id paket", "id tender", "no"],
    "package_name": ["nama paket", "nama tender", "paket", "pekerjaan", "nama pekerjaan"],
    "institution_name": ["instansi", "k/l/pd", "klpd", "kldi", "satuan kerja", "satker"],
    "stage_or_status": ["tahapan", "tahap", "status", "stage"],
    "hps_or_pagu": ["hps", "pagu", "nilai hps", "nilai pagu", "nilai"],
    "fiscal_year": ["tahun anggaran", "tahun", "ta"],
}

# Cell positions of list payloads: the emergency listing differs from the others.
PAYLOAD_POSITIONS = {
    "package_code": 0, "package_name": 1, "institution_name": 2, "stage_or_status": 3,
    "hps_or_pagu": 4, "method": 5,
}
EMERGENCY_SOURCE = "darurat"
EMERGENCY_POSITIONS = {
    "package_code": 0, "package_name": 1, "institution_name": 2, "hps_or_pagu": 3,
    "fiscal_year": 4, "stage_or_status": 7,
}
EMERGENCY_STAGE_FALLBACK = 6

DETAIL_LABELS = {
    "kode_tender": "package_code",
    "kode_paket": "package_code",
    "nama_tender": "package_name",
    "nama_paket": "package_name",
    "k_l_pd_instansi_lainnya": "institution_name",
    "satuan_kerja": "satker",
    "nilai_hps_paket": "hps_or_pagu",
    "nilai_pagu_paket": "hps_or_pagu",
    "tahap_tender_saat_ini": "stage_or_status",
    "tahap_paket_saat_ini": "stage_or_status",
    "metode_pengadaan": "method",
    "tahun_anggaran": "fiscal_year",
}
DETAIL_FIELDS = ["package_code", "package_name", "institution_name", "satker", "hps_or_pagu",
                 "stage_or_status", "method", "fiscal_year"]
RUP_CODE_HEADER = "kode_rup"
RUP_NAME_HEADERS = ["nama_paket", "nama_tender"]
RUP_FUND_HEADERS = ["sumber_dana", "sumber_dana_apbd"]

LINK_SECTIONS = {
    "schedule": ["jadwal", "schedule", "tahap"],
    "participants": ["peserta"],
    "winner": ["pemenang", "hasil"],
    "contract": ["kontrak"],
    "document_links": ["dokumen", "lampiran", "download"],
}

TARGET_KEYWORDS = ["komputer", "laptop", "printer", "cctv", "server", "jaringan", "kamera",
                   "scanner", "perangkat", "alat"]

NAME_STOPWORDS = [
    "belanja", "pengadaan", "tender", "tender ulang", "non tender", "non-tender", "paket",
    "pekerjaan", "jasa", "barang", "konstruksi", "konsultansi", "peralatan", "dan", "untuk",
    "di", "pada", "the", "of", "and", "tahun", "anggaran", "ta",
]

MONTH_NAMES = [
    ("january", 1), ("januari", 1), ("february", 2), ("februari", 2), ("march", 3),
    ("maret", 3), ("april", 4), ("may", 5), ("mei", 5), ("june", 6), ("juni", 6), ("july", 7),
    ("juli", 7), ("august", 8), ("agustus", 8), ("september", 9), ("october", 10),
    ("oktober", 10), ("november", 11), ("december", 12), ("desember", 12),
]

PLAN_LOOKUP_URL = "https://sirup.lkpp.go.id/sirup/ro/penyedia?search="
TENDER_LOOKUP_URL = "https://spse.inaproc.id/?q="
PORTAL_HOST = "spse.inaproc.id"

TRUE_WORDS = ["1", "true", "yes", "y", "aktif", "available", "available public"]
# ---- end of fixed values --------------------------------------------------------------------
