"""Portal registry: provinces, institution categories and software versions."""

# ---- fixed values ---------------------------------------------------------------------------
PROVINCES = [
    "Aceh", "Bali", "Banten", "Bengkulu", "DI Yogyakarta", "DKI Jakarta", "Gorontalo", "Jambi",
    "Jawa Barat", "Jawa Tengah", "Jawa Timur", "Kalimantan Barat", "Kalimantan Selatan",
    "Kalimantan Tengah", "Kalimantan Timur", "Kalimantan Utara", "Kep. Bangka Belitung",
    "Kepulauan Riau", "Lampung", "Maluku", "Maluku Utara", "Nusa Tenggara Barat",
    "Nusa Tenggara Timur", "Papua", "Papua Barat", "Papua Barat Daya", "Papua Pegunungan",
    "Papua Selatan", "Papua Tengah", "Riau", "Sulawesi Barat", "Sulawesi Selatan",
    "Sulawesi Tengah", "Sulawesi Tenggara", "Sulawesi Utara", "Sumatera Barat",
    "Sumatera Selatan", "Sumatera Utara",
]

CATEGORIES = [
    ("Kementerian", "Kementerian"),
    ("Lembaga", "Lembaga"),
    ("Provinsi", "Pemerintah Provinsi"),
    ("Kabupaten", "Pemerintah Kabupaten"),
    ("Kota", "Pemerintah Kota"),
    ("Universitas", "Perguruan Tinggi"),
    ("Sekolah Tinggi", "Perguruan Tinggi"),
    ("Politeknik", "Perguruan Tinggi"),
    ("PTN", "Perguruan Tinggi Negeri"),
    ("BUMN", "BUMN"),
]

VERSION_PATTERNS = [
    r"\bSPSE\s*v?([0-9]+(?:\.[0-9]+)*)\b",
    r"\bPortal\s+eProc\s*v?([0-9]+(?:\.[0-9]+)*)\b",
    r"\bInaproc\s*v?([0-9]+(?:\.[0-9]+)*)\b",
]

QUALITY_FLAGS = ["province_mismatch_suspected", "missing_official_url", "missing_domain",
                 "missing_spse_version", "inactive_or_inaccessible"]

PARENT_PORTAL = "https://eproc.lkpp.go.id"
DETAIL_LINK_TEXT = "Detail LPSE"
PORTAL_LINK_TEXT = "Ke Halaman Web LPSE"
DETAIL_LABELS = ["PROVINSI", "ALAMAT", "EMAIL", "HELPDESK", "URL",
                 "STATUS SERVER TERAKHIR PADA"]

NAME_RULE_VERSION = "KLDI_LPSE_STRICT_NAME_V1"
ROUTING_SCOPE = "ROUTING_ONLY"
PLAN_ROUTING_FIELDS = ["canonical_kldi_id", "source_kldi_name", "acquisition_run_id",
                       "receipt_chain_reference", "receipt_chain_hash", "source_version"]
REGISTRY_ROUTING_FIELDS = ["lpse_name", "official_lpse_url", "registry_artifact_id",
                           "registry_artifact_hash", "registry_version"]
# ---- end of fixed values --------------------------------------------------------------------
