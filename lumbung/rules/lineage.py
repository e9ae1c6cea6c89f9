"""Snapshot schema, gates and the hash-chained run log."""

# ---- fixed values ---------------------------------------------------------------------------
REQUIRED_FIELDS = ["id", "id_referensi", "pagu", "satuanKerja", "kldi", "lokasi",
                   "jenisPengadaan", "metode", "sumberDana", "paket", "pemilihan", "idBulan",
                   "idSatker", "idKldi"]

MANIFEST_FIELDS = ["manifest_version", "run_id", "status", "full_snapshot",
                   "promotion_eligible", "database_path", "table_name", "requested_limit",
                   "row_count", "distinct_id_count", "min_id", "max_id", "sha256", "validation",
                   "promotion"]

COMMON_GATES = ["manifest_exists", "duckdb_exists", "schema_valid", "row_count_nonzero",
                "unique_ids", "no_null_ids", "manifest_consistent", "sha256_verified",
                "source_count_recorded", "full_source_count_collected",
                "collection_gates_recorded_passed", "receipt_chain_valid"]
STEADY_GATES = ["comparison_report_available", "comparison_report_valid"]
GENESIS_GATES = ["genesis_context_valid", "genesis_selection_state_valid",
                 "genesis_manifest_contract_valid", "genesis_full_source_accounting_valid",
                 "genesis_collection_provenance_valid", "genesis_promotion_state_valid"]
FINAL_GATE = "promotion_flag_remains_false"

LOG_TYPES = ["ANCHOR", "PAGE", "RETRY", "RESUME", "COMPLETION", "ABORT"]
TERMINAL_TYPES = ["COMPLETION", "ABORT"]
NORMAL_COMPLETION = "NORMAL_COMPLETION"
NO_DRIFT = "NO_DRIFT"

DECISION_KEYS = ["schema", "version", "decision_id", "kind", "result", "subject", "provenance",
                 "evidence_references", "timestamp", "bindings"]
AUTHORITATIVE_LINKS = ["EXACT_RUP_ID_FROM_EXECUTION_DETAIL",
                       "EXACT_KODE_RUP_FROM_EXECUTION_DETAIL", "EXACT_SOURCE_REFERENCE"]
REASON_PLAN = "CURRENT_RUP_NOT_VERIFIED"
REASON_PRODUCT = "PRODUCT_COMPATIBILITY_NOT_VERIFIED"
REASON_CONTACT = "CONTACT_NOT_VERIFIED"
REASON_APPROVAL = "EXPLICIT_APPROVAL_GATE_NOT_IMPLEMENTED"
# ---- end of fixed values --------------------------------------------------------------------
