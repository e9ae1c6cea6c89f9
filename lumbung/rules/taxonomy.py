"""Demand taxonomy: families, context terms and printing patterns."""

# ---- fixed values (must equal the published taxonomy) ---------------------------------------
TAXONOMY_VERSION = "DEMAND_TAXONOMY_V1_CANDIDATE_FINAL_R2_2_2026-08-14"
TAXONOMY_SHA256 = "3864ef756fc96aa5e0454335f0ac38154d3a3417a6e5300b781ed550f657ffe0"
PRINTING_RESOLVER_VERSION = "V6.7.8"

FAMILIES = [
    "AIR_CONDITIONING", "AUDIO_CONFERENCE", "CAMERA", "CCTV", "COMPUTING", "DISPLAY", "DRONE",
    "MEDICAL_LAB", "MEDICAL_MONITOR", "NETWORKING", "NETWORK_MATERIAL", "OFFICE_APPLIANCE",
    "OFFICE_FURNITURE", "POWER", "PRINTING_CONSUMABLES", "PRINTING_HARDWARE", "SERVER", "STORAGE",
    "VIDEO_CONFERENCE_HARDWARE", "VIDEO_CONFERENCE_SOFTWARE_LICENSE",
]

STATES = [
    "PURCHASE_EXPLICIT", "PRODUCT_ONLY_UNCONTRADICTED", "PARTS_CONSUMABLE",
    "MAINTENANCE_CALIBRATION", "RENTAL_SUBSCRIPTION_LICENSE", "INSTALLATION_CONTEXT",
    "SERVICE_CONTEXT", "MEDIA_SERVICE", "CONSULTING_OR_LABOR_SERVICE", "CONNECTIVITY_SERVICE",
    "NO_GOVERNED_DEMAND_MATCH",
]

FAMILY_TERMS = {
    "AIR_CONDITIONING": ["air conditioner", "air conditioning", "ac split", "pendingin ruangan"],
    "AUDIO_CONFERENCE": ["microphone", "mikrofon", "conference microphone", "audio conference"],
    "CAMERA": ["kamera", "camera digital", "digital camera", "camera mirrorless",
               "mirrorless camera", "camera dslr", "dslr camera"],
    "CCTV": ["cctv"],
    "COMPUTING": ["laptop", "notebook", "desktop pc", "komputer desktop", "pc desktop",
                  "desktop computer", "all in one pc", "aio pc", "mini pc", "workstation"],
    "DISPLAY": ["digital signage", "interactive display", "interactive flat panel", "televisi",
                "monitor pc", "pc monitor", "led monitor", "lcd monitor", "monitor led",
                "monitor lcd", "monitor cctv", "display monitor", "pengadaan led display",
                "belanja led display", "peralatan led display"],
    "DRONE": ["drone", "dji", "gimbal"],
    "MEDICAL_LAB": ["dental chair", "mikroskop", "microscope", "centrifuge",
                    "refrigerated centrifuge", "low speed centrifuge", "autoclave",
                    "dermatoscope", "alat laboratorium", "laboratory equipment"],
    "MEDICAL_MONITOR": ["patient monitor", "pasien monitor", "invasive monitor",
                        "blood pressure monitor", "nibp monitor"],
    "NETWORKING": ["router", "network switch", "access point", "wireless access point",
                   "perangkat switch jaringan", "access switch jaringan"],
    "NETWORK_MATERIAL": ["kabel jaringan utp", "kabel lan", "kabel fiber optic",
                         "kabel fiber optik", "jaringan fiber optic", "jaringan fiber optik",
                         "peralatan fiber optic", "peralatan fiber optik",
                         "backbone fiber optic", "backbone fiber optik", "gpon",
                         "fusion splicer", "optical time domain reflectometer"],
    "OFFICE_APPLIANCE": ["dispenser", "coffee machine", "mesin kopi", "paper shredder",
                         "penghancur kertas"],
    "OFFICE_FURNITURE": ["meja kantor", "kursi kantor", "meja kerja", "kursi kerja",
                         "meja rapat", "kursi rapat", "lemari arsip", "filing cabinet"],
    "POWER": ["ups", "uninterruptible power supply", "stabilizer listrik"],
    "SERVER": ["server", "rack server"],
    "STORAGE": ["network attached storage", "nas storage", "storage server",
                "hard disk eksternal", "external ssd", "ssd eksternal"],
    "VIDEO_CONFERENCE_HARDWARE": ["conference camera", "video conference camera",
                                  "camera video conference", "perangkat video conference",
                                  "alat video conference", "sistem video conference"],
    "VIDEO_CONFERENCE_SOFTWARE_LICENSE": ["lisensi video conference",
                                          "aplikasi video conference",
                                          "langganan video conference",
                                          "video conferencing", "teleconference"],
}

UNVERIFIED_TERMS = [
    "tower server", "blade server", "surveillance camera", "conference speaker",
    "speaker conference", "web conference", "firewall appliance", "external hard drive",
    "voltage stabilizer", "kursi dental", "timbangan medis",
]

# Context states, strongest first; purchase is only consulted when none of them applies.
CONTEXT_TERMS = {
    "MAINTENANCE_CALIBRATION": ["pemeliharaan", "pemelihaaran", "maintenance", "perawatan",
                                "perbaikan", "service", "servis", "harwat", "kalibrasi"],
    "RENTAL_SUBSCRIPTION_LICENSE": ["sewa", "rental", "langganan", "berlangganan",
                                    "subscription", "lisensi", "license"],
    "MEDIA_SERVICE": ["advertorial", "publikasi", "media televisi", "iklan", "reklame",
                      "spot iklan", "tvc", "lipsus"],
    "CONSULTING_OR_LABOR_SERVICE": ["jasa konsultansi", "konsultan", "tenaga ahli",
                                    "programmer", "jasa tenaga"],
    "INSTALLATION_CONTEXT": ["instalasi", "pemasangan"],
    "SERVICE_CONTEXT": ["pemotretan"],
    "CONNECTIVITY_SERVICE": ["jasa internet", "layanan internet", "koneksi internet"],
}
PURCHASE_TERMS = ["pengadaan", "pembelian", "belanja modal", "belanja barang", "belanja alat",
                  "belanja peralatan"]

CONSUMABLE_PHRASE = "centrifuge tube"
CONSUMABLE_PHRASE_SUPPRESSES = ("MEDICAL_LAB", "centrifuge")

# Phrases in which "printer" only names what a consumable is for.
PRINTING_CONSUMABLE_PATTERNS = [
    r"\btinta printer\b",
    r"\bpita printer\b",
    r"\b(?:refill|refil) (?:ink )?printer(?: laserjet)?\b",
    r"\b(?:refill|refil) (?:ink|toner)\b",
    r"\btoner(?: untuk)? printer\b",
    r"\btoner laserjet\b",
    r"\bcartridge printer\b",
    r"\bperlengkapan printer berupa toner\b",
    r"\bkebutuhan printer tinta dan pita printer\b",
]
# Contexts in which an occurrence of "printer" is not hardware on its own.
PRINTER_REFERENTIAL_BEFORE = ["tinta", "pita", "cartridge", "toner", "toner untuk", "refill",
                              "refil", "refill ink", "refil ink"]
PRINTER_REFERENTIAL_PHRASES = [
    ("perlengkapan ", " berupa toner"),
    ("kebutuhan ", " tinta dan pita printer"),
]

# Family -> product line (an example catalogue; pass another map for another catalogue).
FAMILY_PRODUCTS = {
    "AUDIO_CONFERENCE": ["camera-video-general"],
    "CAMERA": ["camera-video-general"],
    "CCTV": ["cctv-general"],
    "COMPUTING": ["laptop-general"],
    "NETWORKING": ["networking-general"],
    "NETWORK_MATERIAL": ["networking-general"],
    "OFFICE_FURNITURE": ["office-furniture-general"],
    "POWER": ["ups-general"],
    "PRINTING_CONSUMABLES": ["printer-general"],
    "PRINTING_HARDWARE": ["printer-general"],
    "SERVER": ["server-general"],
    "STORAGE": ["storage-general"],
    "VIDEO_CONFERENCE_HARDWARE": ["camera-video-general"],
}
# ---- end of fixed values --------------------------------------------------------------------
