"""Institution outreach: product categories, target levels, stages and labels."""

# ---- fixed values ---------------------------------------------------------------------------
CATEGORY_TERMS = {
    "LAPTOP": ["laptop", "notebook", "chromebook"],
    "DESKTOP": ["desktop", "pc desktop", "personal computer", "komputer desktop", "komputer pc"],
    "PRINTER": ["printer", "pencetak", "plotter"],
    "SCANNER": ["scanner", "pemindai"],
    "NETWORKING": ["jaringan komputer", "komputer jaringan", "jaringan internet",
                   "jaringan intranet", "network", "internet", "intranet", "router", "switch",
                   "access point", "wireless", "wifi", "firewall", "lan"],
    "SERVER": ["server", "blade", "rackmount"],
    "STORAGE": ["storage", "nas", "san", "harddisk", "hard disk", "ssd", "penyimpanan"],
    "UPS": ["ups", "uninterruptible power", "stabilizer"],
    "CCTV": ["cctv", "surveillance"],
    "CAMERA_VIDEO": ["kamera", "camera", "video conference", "videotron", "webcam"],
    "AUDIO": ["audio", "speaker", "microphone", "mikrofon", "sound system"],
    "OFFICE_FURNITURE": ["meubel", "mebel", "furniture", "furnitur", "kursi", "meja",
                         "lemari arsip"],
    "IT_HARDWARE": ["komputer", "perangkat tik", "peralatan tik", "perangkat it", "peralatan it",
                    "hardware", "monitor"],
}
CATEGORY_VETO = ["alat kesehatan", "alkes", "obat", "farmasi", "reagen", "bahan medis", "bmhp",
                 "vaksin", "ambulance", "ambulans"]

# Substring markers, checked level by level; the first level with a hit wins.
TARGET_LEVELS = {
    "PROVINCE": ["provinsi ", "prov.", "prov "],
    "NATIONAL": [
        "kementerian", "badan pusat statistik", "arsip nasional", "badan gizi nasional",
        "badan karantina indonesia", "badan kepegawaian negara", "badan meteorologi",
        "badan narkotika nasional", "badan nasional", "badan pemeriksa keuangan",
        "badan pengawas obat", "badan pengawas pemilihan umum", "badan pengawasan keuangan",
        "badan pengusahaan kawasan perdagangan bebas", "badan riset dan inovasi nasional",
        "badan siber dan sandi negara", "mahkamah", "kejaksaan", "mabes", "tni", "polri", "dpr",
        "mpr", "dewan perwakilan rakyat", "sekretariat jenderal", "setjen", "kantor wilayah",
        "kantor pusat", "direktorat jenderal", "dirjen", "lembaga", "komisi", "badan otorita",
    ],
    "HOSPITAL": ["rumah sakit", "rsud", "rsu", "rs ", "rs-"],
    "HEALTH_UNIT": ["puskesmas", "poskesdes", "labkesda", "laboratorium kesehatan",
                    "balai kesehatan"],
    "EDUCATION": ["dinas pendidikan", "sekolah", "madrasah", "universitas", "institut",
                  "politeknik", "akademi", "kampus", "fakultas", "sma", "smk", "smp", "sd"],
    "LOCAL_AGENCY": [
        "dinas ", "badan ", "sekretariat daerah", "kantor ", "kecamatan", "kelurahan",
        "kabupaten", "kab. ", "kab.", "kota", "uptd", "upt ", "blud", "balai ", "bappeda",
        "dishub", "diskominfo", "dinsos", "disper", "disdik", "bpbd", "satpol pp",
        "pemerintah daerah", "pemda",
    ],
}
OTHER_LEVEL = "OTHER"

RESEARCH_PRIORITY_CATEGORIES = ["LAPTOP", "DESKTOP", "PRINTER", "SCANNER", "NETWORKING", "SERVER",
                                "STORAGE", "UPS", "CCTV", "CAMERA_VIDEO"]
RESEARCH_LEVEL_ORDER = ["LOCAL_AGENCY", "HOSPITAL", "EDUCATION", "HEALTH_UNIT", "OTHER",
                        "NATIONAL", "PROVINCE", "REVIEW"]

CATEGORY_ALIASES = {
    "LAPTOP": ["LAPTOP", "IT_HARDWARE"],
    "PRINTER": ["PRINTER", "IT_HARDWARE"],
    "SCANNER": ["SCANNER", "IT_HARDWARE"],
    "CCTV": ["CCTV", "IT_HARDWARE"],
    "NETWORKING": ["NETWORKING", "IT_HARDWARE"],
    "SERVER": ["SERVER", "IT_HARDWARE"],
    "STORAGE": ["STORAGE", "IT_HARDWARE"],
    "UPS": ["UPS", "IT_HARDWARE"],
    "CAMERA_VIDEO": ["CAMERA_VIDEO", "IT_HARDWARE"],
    "OFFICE_FURNITURE": ["OFFICE_FURNITURE"],
    "IT_HARDWARE": ["IT_HARDWARE"],
}

# Product category from a product name, first rule wins.
PRODUCT_CATEGORY_TERMS = {
    "PRINTER": ["printer"],
    "SCANNER": ["scanner", "pemindai"],
    "CCTV": ["cctv"],
    "NETWORKING": ["network", "switch", "router", "jaringan"],
    "SERVER": ["server"],
    "STORAGE": ["storage", "nas", "ssd"],
    "UPS": ["ups"],
    "CAMERA_VIDEO": ["camera", "kamera", "video"],
    "OFFICE_FURNITURE": ["meja", "kursi", "furniture", "mebel"],
    "LAPTOP": ["laptop", "notebook"],
}
PRODUCT_CATEGORY_DEFAULT = "IT_HARDWARE"

PRODUCT_LINES = [
    ("laptop-general", "LAPTOP", ["laptop", "notebook", "2in1", "komputer jinjing"]),
    ("printer-general", "PRINTER", ["printer", "all in one", "multifunction", "a4", "a3"]),
    ("scanner-general", "SCANNER", ["scanner", "pemindai", "scan dokumen", "adf"]),
    ("cctv-general", "CCTV", ["cctv", "surveillance", "kamera pengawas", "nvr"]),
    ("networking-general", "NETWORKING",
     ["network", "networking", "switch", "router", "access point", "jaringan"]),
    ("server-general", "SERVER", ["server", "rack server", "tower server"]),
    ("ups-general", "UPS",
     ["ups", "uninterruptible power supply", "backup power", "catu daya"]),
    ("storage-general", "STORAGE", ["storage", "nas", "hard disk", "ssd", "penyimpanan"]),
    ("camera-video-general", "CAMERA_VIDEO",
     ["camera", "kamera", "video", "webcam", "conference"]),
    ("office-furniture-general", "OFFICE_FURNITURE",
     ["furniture", "meja", "kursi", "lemari", "mebel"]),
]

TIMELINE_EVENTS = [
    ("COLD_EMAIL_DRAFTED", "Draf Email Dibuat"),
    ("DRAFT_APPROVED", "Draf Disetujui"),
    ("EMAIL_SENT", "Email Terkirim"),
    ("FOLLOW_UP_1", "Tindak Lanjut 1"),
    ("FOLLOW_UP_2", "Tindak Lanjut 2"),
    ("PHONE_CALL", "Telepon"),
    ("MEETING", "Meeting"),
    ("QUOTATION", "Penawaran"),
    ("CLOSED_WON", "Menang"),
    ("CLOSED_LOST", "Kalah"),
]
MANUAL_EVENTS = ["FOLLOW_UP_1", "FOLLOW_UP_2", "PHONE_CALL", "MEETING", "QUOTATION"]
NO_TIMELINE_LABEL = "Belum ada aktivitas CRM"

STAGES = ["Drafts", "Under Review", "Approved", "Ready to Send", "Sent", "Failed"]
DRAFT_WORK_STATES = ["GENERATED", "EDITED", "SAVED"]

STATUS_LABELS = {
    "NOT_CONTACTED": "Belum Dihubungi",
    "DRAFT_GENERATED": "Draf Dibuat",
    "DRAFT_EDITED": "Draf Diedit",
    "GENERATED": "Dibuat",
    "EDITED": "Diedit",
    "SAVED": "Disimpan",
    "UNDER_REVIEW": "Dalam Peninjauan",
    "APPROVED": "Disetujui",
    "READY_TO_SEND": "Siap Dikirim",
    "SENT": "Terkirim",
    "FAILED": "Gagal",
    "CONTACT_FOUND": "Kontak Ditemukan",
    "CONTACT_NEEDS_REVIEW": "Kontak Perlu Ditinjau",
    "CONTACT_MISSING": "Kontak Belum Ada",
    "READY_FOR_CONTACT_SEARCH": "Siap Ditindaklanjuti",
    "NEEDS_REVIEW": "Perlu Ditinjau",
    "SIRUP_PLANNING_ONLY": "Bukti Perencanaan SiRUP",
    "SPSE_NOT_CHECKED_NATIONALLY": "SPSE Belum Dicek Nasional",
    "INAPROC_PENDING_VERIFICATION": "Menunggu Verifikasi INAPROC",
    "MANUAL_SEED_V1": "Data Awal Manual",
    "not_sent": "Belum Dikirim",
    "sent": "Terkirim",
    "failed": "Gagal",
}
DRAFT_STATUS_LABELS = {
    "NOT_GENERATED": "Belum Dibuat",
    "GENERATED": "Dibuat",
    "EDITED": "Diedit",
    "SAVED": "Disimpan",
    "UNDER_REVIEW": "Dalam Peninjauan",
    "APPROVED": "Disetujui",
    "READY_TO_SEND": "Siap Dikirim",
    "SENT": "Terkirim",
}
UNKNOWN_STATUS_LABEL = "Tidak Tersedia"

CONTACT_VERIFICATION_SOURCE = "OFFICIAL_INSTITUTION_WEBSITE"
# ---- end of fixed values --------------------------------------------------------------------
