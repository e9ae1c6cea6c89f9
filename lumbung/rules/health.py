"""Health-sector lead vocabulary."""

# ---- fixed values ---------------------------------------------------------------------------
# Terms matched as whole words; every other term is matched as a substring.
WHOLE_WORDS = ["lab", "icu", "nicu", "igd", "ugd"]

KEYWORDS = [
    "alat kesehatan", "alkes", "kesehatan", "rumah sakit", "rsud", "puskesmas", "klinik",
    "laboratorium", "lab", "medis", "medical", "hospital", "health", "diagnostic", "diagnostik",
    "patient monitor", "monitor pasien", "ventilator", "oxygen", "oksigen", "oximeter",
    "tensimeter", "sphygmomanometer", "stethoscope", "stetoskop", "infusion", "infus",
    "syringe pump", "suction", "usg", "ultrasound", "x-ray", "rontgen", "radiologi", "ct scan",
    "dental", "gigi", "bed pasien", "tempat tidur pasien", "kursi roda", "ambulance", "ambulan",
    "autoclave", "sterilizer", "alat bedah", "operasi", "ICU", "NICU", "IGD", "UGD", "emergency",
    "farmasi", "bmhp", "hematology analyzer", "chemistry analyzer", "cathlab", "electrocauter",
    "defibrillator", "nebulizer", "ekg", "ecg", "endoscopy", "endoskopi",
]

EQUIPMENT_KEYWORDS = [
    "alat kesehatan", "alkes", "peralatan kesehatan", "alat medis", "bmhp", "bahan medis",
    "medical equipment", "diagnostic", "diagnostik", "patient monitor", "monitor pasien",
    "ventilator", "oxygen", "oksigen", "oximeter", "tensimeter", "sphygmomanometer",
    "stethoscope", "stetoskop", "infusion", "infus", "syringe pump", "suction", "usg",
    "ultrasound", "x-ray", "rontgen", "radiologi", "ct scan", "dental", "gigi", "bed pasien",
    "tempat tidur pasien", "kursi roda", "ambulance", "ambulan", "autoclave", "sterilizer",
    "alat bedah", "operasi", "icu", "nicu", "igd", "ugd", "emergency", "farmasi",
    "laboratorium", "lab", "hematology analyzer", "chemistry analyzer", "cathlab",
    "electrocauter", "meja instrumen", "incubator", "defibrillator", "nebulizer", "ekg", "ecg",
    "endoscopy", "endoskopi",
]

CONTEXT_KEYWORDS = ["kesehatan", "rumah sakit", "rsud", "puskesmas", "klinik", "hospital",
                    "health", "medis", "farmasi", "laboratorium", "lab"]

EXCLUDE_KEYWORDS = [
    "jurnal", "surat kabar", "majalah", "jaminan kesehatan", "iuran", "konstruksi", "gedung",
    "bangunan", "pemeliharaan gedung", "perjalanan dinas", "honor", "gaji", "makan minum",
    "langganan", "listrik", "air", "internet", "cleaning service", "keamanan", "parkir",
    "sewa gedung",
]
GOODS_TYPE = "Barang"

# Ordered classes, first class with a contained term wins.
SECTORS = {
    "Healthcare": ["kesehatan", "rumah sakit", "rsud", "puskesmas", "klinik", "farmasi",
                   "medical", "hospital", "health"],
    "Education": ["pendidikan", "universitas", "sekolah"],
    "Defense / Public Safety": ["pertahanan", "tni", "polri"],
}
SECTOR_DEFAULT = "Public Sector"

INSTITUTION_TYPES = {
    "Hospital": ["rumah sakit", "rsud", "hospital"],
    "Primary Care / Puskesmas": ["puskesmas"],
    "Health Agency": ["dinas kesehatan"],
    "Clinic": ["klinik"],
    "Central Health Ministry": ["kementerian kesehatan"],
    "Pharmacy / Health Supply Unit": ["farmasi"],
}
INSTITUTION_TYPE_DEFAULT = "Public Institution"

EQUIPMENT_CLASSES = {
    "Diagnostic / Laboratory Equipment": [
        "hematology", "chemistry analyzer", "diagnostic", "diagnostik", "laboratorium", " lab",
        "x-ray", "rontgen", "radiologi", "ct scan", "usg", "ultrasound", "cathlab", "ekg", "ecg"],
    "Patient Care / Monitoring Equipment": [
        "patient monitor", "monitor pasien", "ventilator", "infusion", "infus", "syringe pump",
        "suction", "icu", "nicu", "bed pasien", "tempat tidur", "troli emergency", "nebulizer",
        "defibrillator"],
    "Dental Equipment": ["dental", "gigi"],
    "Emergency / Ambulance Equipment": ["ambulance", "ambulan", "emergency", "igd", "ugd"],
    "Sterilization Equipment": ["autoclave", "sterilizer", "sterilisasi"],
    "Pharmacy / Medical Consumables": ["obat", "farmasi", "vaksin"],
    "Medical Devices / Consumables": ["alat kesehatan", "alkes", "peralatan kesehatan",
                                      "alat medis", "bmhp", "bahan medis"],
}
EQUIPMENT_CONTEXT_CLASS = "Healthcare Equipment / Supplies"
EQUIPMENT_DEFAULT = "Healthcare Procurement"

READY_BOTH = "Email + phone/WhatsApp available"
READY_EMAIL = "Email available"
READY_PHONE = "Phone/WhatsApp available"
READY_NONE = "Missing direct contact"

HIGH_BUDGET = 1_000_000_000
MID_BUDGET = 250_000_000
LOW_BUDGET = 50_000_000

ACTION_RESEARCH = "Research official contact before outreach"
ACTION_INTRODUCE = "Review package fit and prepare targeted B2B introduction"
ACTION_VALIDATE = "Validate need and institution context before outreach"
ACTION_MONITOR = "Keep for monitoring"

LEAD_NOTE = "Verify institution fit and contact details before any outreach."
# ---- end of fixed values --------------------------------------------------------------------
