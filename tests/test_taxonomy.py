from lumbung.operators import taxonomy
from lumbung.rules import taxonomy as R

PURCHASE, PRODUCT, PARTS = "PURCHASE_EXPLICIT", "PRODUCT_ONLY_UNCONTRADICTED", "PARTS_CONSUMABLE"
NONE = "NO_GOVERNED_DEMAND_MATCH"
RENT, CARE = "RENTAL_SUBSCRIPTION_LICENSE", "MAINTENANCE_CALIBRATION"
INK, PRINT = "PRINTING_CONSUMABLES", "PRINTING_HARDWARE"

# title, expected state, expected families
GOLDEN = [
    ("Pengadaan Pemeliharaan Printer", CARE, [PRINT]),
    ("Sewa Laptop", RENT, ["COMPUTING"]),
    ("Laptop", PRODUCT, ["COMPUTING"]),
    ("Tinta Printer", PARTS, [INK]),
    ("Patient Monitor", PRODUCT, ["MEDICAL_MONITOR"]),
    ("Iklan Media Televisi", "MEDIA_SERVICE", ["DISPLAY"]),
    ("Lisensi Video Conference", RENT, ["VIDEO_CONFERENCE_SOFTWARE_LICENSE"]),
    ("Fiber Optic Laryngoscope", NONE, []),
    ("Pemotretan Drone", "SERVICE_CONTEXT", ["DRONE"]),
    ("Kalibrasi Centrifuge", CARE, ["MEDICAL_LAB"]),
    ("Pengadaan Pemeliharaan AC Split", CARE, ["AIR_CONDITIONING"]),
    ("Pengadaan Sewa Laptop", RENT, ["COMPUTING"]),
    ("Lisensi Remote Desktop", RENT, []),
    ("Balai Monitor SFR Kelas II", NONE, []),
    ("Pengadaan PC Monitor 24 Inch", PURCHASE, ["DISPLAY"]),
    ("Pengadaan Patient Monitor", PURCHASE, ["MEDICAL_MONITOR"]),
    ("Langganan Internet Fiber Optik", RENT, []),
    ("Pengadaan Kabel Fiber Optik", PURCHASE, ["NETWORK_MATERIAL"]),
    ("Centrifuge Tube", PARTS, []),
    ("Pengadaan Refrigerated Centrifuge", PURCHASE, ["MEDICAL_LAB"]),
    ("Metric Aerial Camera and Lidar Survey", NONE, []),
    ("Pengadaan Camera Mirrorless", PURCHASE, ["CAMERA"]),
    ("Refill Printer Laserjet HP 35 A", PARTS, [INK]),
    ("Toner untuk printer Dit. Prestasi", PARTS, [INK]),
    ("Pengadaan Perlengkapan Printer berupa toner", PARTS, [INK]),
    ("Kebutuhan Printer (Tinta dan Pita Printer)", PARTS, [INK]),
    ("Refill Ink Printer dan Laser Pointer", PARTS, [INK]),
    ("Tinta Epson EcoTank 003 Original Yellow Refil Ink Printer L1110 L3110 L3150 L5190", PARTS,
     [INK]),
    ("BLUD - Penyediaan Refill Toner Printer Laserjet", PARTS, [INK]),
    ("Belanja Refil Toner / Cartridge Printer Laserjet", PARTS, [INK]),
    ("Printer", PRODUCT, [PRINT]),
    ("Pengadaan Printer", PURCHASE, [PRINT]),
    ("Printer Laserjet", PRODUCT, [PRINT]),
    ("Belanja Modal Printer Inkjet", PURCHASE, [PRINT]),
    ("Pengadaan Printer dan Tinta Printer", PURCHASE, [INK, PRINT]),
    ("Printer LaserJet dan Toner LaserJet", PRODUCT, [INK, PRINT]),
    ("Pekerjaan Pengadaan Laptop, Printer, Tinta Printer dan Modem", PURCHASE,
     ["COMPUTING", INK, PRINT]),
    ("Refill Ink Epson dan Printer Inkjet Multifungsi, up to A4", PRODUCT, [INK, PRINT]),
    ("  PENGADAAN—LAPTOP\t", PURCHASE, ["COMPUTING"]),
    ("notebooking", NONE, []),
    ("Ｌａｐｔｏｐ", PRODUCT, ["COMPUTING"]),
] + [(term, NONE, []) for term in R.UNVERIFIED_TERMS]


def test_golden_titles(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in GOLDEN], "title string").repartition(3)
    got = {r.title: r for r in taxonomy.classify(df, "title").collect()}
    for title, state, families in GOLDEN:
        row = got[title]
        assert (row.semantic_state, row.demand_families) == (state, families), title
        assert row.rule_ids[-1] == f"STATE.{state}"
        assert {m.family for m in row.matched_terms} <= set(families)


def test_type_settles_the_state_but_never_a_family(spark):
    df = spark.createDataFrame([("unknown", "Pengadaan Laptop")], "title string, kind string")
    row = taxonomy.classify(df, "title", "kind").first()
    assert row.demand_families == [] and row.semantic_state == PURCHASE


def test_overlapping_phrases_and_products(spark):
    df = spark.createDataFrame([("Refill Toner Printer Laserjet dan CCTV",)], "title string")
    row = taxonomy.relevant_products(df, "title").first()
    assert [m.term for m in row.matched_terms] == ["cctv", "refill toner", "toner printer"]
    assert row.matched_product_ids == ["cctv-general", "printer-general"]
