"""Plan-to-evidence matching: signals, conflicts and thresholds."""

# ---- fixed values ---------------------------------------------------------------------------
PRIMARY_SIGNALS = ["PACKAGE_NAME", "INSTITUTION", "SATKER"]
HARD_CONFLICTS = ["INSTITUTION_CONFLICT", "SATKER_CONFLICT", "PACKAGE_IDENTITY_CONFLICT",
                  "MAJOR_PROCUREMENT_METHOD_CONFLICT"]
REJECTION_LABELS = {
    "INSTITUTION_CONFLICT": "REJECTED_INSTITUTION_CONFLICT",
    "SATKER_CONFLICT": "REJECTED_SATKER_CONFLICT",
    "PACKAGE_IDENTITY_CONFLICT": "REJECTED_PACKAGE_CONFLICT",
    "MAJOR_PROCUREMENT_METHOD_CONFLICT": "REJECTED_PROCUREMENT_METHOD_CONFLICT",
}
REJECTED_MIXED = "REJECTED_IDENTITY_CONFLICT"

SIGNAL_TEXT = 0.80
SIGNAL_BUDGET = 0.85
CONFLICT_INSTITUTION = 0.65
CONFLICT_SATKER = 0.65
CONFLICT_NAME = 0.45
CONFLICT_BUDGET = 0.70
CONFLICT_OTHER = 0.50

E_PURCHASING_TERMS = ["e purchasing", "epurchasing", "katalog"]
NON_TENDER_TERMS = ["non tender", "pengadaan langsung"]
TENDER_TERMS = ["tender", "seleksi"]

REVIEW_TIE = "Top candidates have identical deterministic identity rank."
REVIEW_WEAK = "Candidate evidence is insufficient for signal-based acceptance."
EXPLAIN_NONE = "No local procurement evidence candidate was found."
EXPLAIN_REJECTED = "All discovered candidates were rejected before ranking by HARD conflict."
EXPLAIN_RULES = ("Decision follows registered signals after HARD-conflict rejection; "
                 "diagnostic confidence did not authorize classification.")
APPLIED_RULES = [
    "RULE_1_NAMESPACE_SEPARATION", "RULE_2_MULTI_SIGNAL", "RULE_3_HARD_CONFLICT_REJECTION",
    "RULE_4_IDENTITY_BEFORE_STATUS", "RULE_5_STATUS_NOT_RANKED",
    "RULE_7_CONFIDENCE_DIAGNOSTIC_ONLY", "RULE_8_HARD_CONFLICT_NEVER_OVERRIDDEN",
    "RULE_9_LOCKED_CONFLICT_REGISTRY", "RULE_10_DETERMINISTIC_REPLAY",
]
# ---- end of fixed values --------------------------------------------------------------------
