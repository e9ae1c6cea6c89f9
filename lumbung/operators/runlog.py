"""Acquired pages, quarantine, provenance, accounting and the hash-chained run log."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.functions.digests import digest_of
from lumbung.operators.scan import previous, running
from lumbung.rules import lineage as R

GENESIS = hashlib.sha256(b"RECEIPT-CHAIN-V1-GENESIS").hexdigest()
HEX64 = "^[0-9a-f]{64}$"


# ---- pages -----------------------------------------------------------------------------------
def parse_pages(pages: DataFrame, full_snapshot: bool = True) -> DataFrame:
    """Check each page payload; adds ``page_error`` (null when sound) and the parsed rows.

    ``pages``: run_id, page_start, requested_length, page_draw, payload and, optionally,
    expected_source_count.
    """
    parsed = pages.withColumn("_doc", F.try_parse_json("payload"))
    data = F.try_variant_get("_doc", "$.data", "variant")
    total = F.try_variant_get("_doc", "$.recordsFiltered", "variant")
    source_count = F.when(F.schema_of_variant(total) == "BIGINT",
                          F.try_variant_get("_doc", "$.recordsFiltered", "bigint"))
    rows = F.when(F.schema_of_variant(data).startswith("ARRAY"),
                  F.try_variant_get("_doc", "$.data", "array<variant>"))
    # Sorted keys, no spacing: the order the variant encoding keeps.
    out = parsed.withColumns({"_rows": rows, "source_count": source_count,
                              "_kind": F.schema_of_variant("_doc"),
                              "payload_sha256": F.sha2(F.to_json("_doc"), 256)}).drop("_doc")
    expected = F.col("requested_length")
    if full_snapshot:
        expected = F.least(expected, F.col("source_count") - F.col("page_start"))
    known = (F.col("expected_source_count") if "expected_source_count" in pages.columns
             else F.lit(None).cast("long"))
    error = (
        F.when(~F.coalesce(F.col("_kind"), F.lit("")).startswith("OBJECT"),
               "response payload is not an object")
        .when(F.col("source_count").isNull(), "response field 'recordsFiltered' is not an integer")
        .when(known.isNotNull() & (known != F.col("source_count")), F.concat(
            F.lit("source record count changed: expected "), known.cast("string"),
            F.lit(", observed "), F.col("source_count").cast("string")))
        .when(F.col("_rows").isNull(), "response field 'data' is not an array")
        .when(F.size("_rows") != expected, F.concat(
            F.lit("expected "), expected.cast("string"), F.lit(" rows but source returned "),
            F.size("_rows").cast("string"))))
    return out.withColumn("page_error", error).drop("_kind")


PAGE_COLUMNS = ["run_id", "page_start", "requested_length", "page_draw", "payload_sha256",
                "source_count"]


def page_rows(parsed: DataFrame) -> DataFrame:
    """One row per source row of the sound pages, in canonical JSON."""
    sound = parsed.where(F.col("page_error").isNull())
    return sound.select(*PAGE_COLUMNS, F.posexplode("_rows").alias("row_index", "_row")).select(
        *PAGE_COLUMNS, "row_index", (F.col("page_start") + F.col("row_index")).alias(
            "source_offset"), F.to_json("_row").alias("raw_row"))


def page_failures(parsed: DataFrame) -> DataFrame:
    """Failure records of the unsound pages, payload included."""
    return parsed.where(F.col("page_error").isNotNull()).select(
        "run_id", F.col("page_start").alias("start"), F.col("requested_length").alias("length"),
        F.col("page_draw").alias("draw"), F.col("source_count").alias("observed_source_count"),
        F.col("page_error").alias("validation_error"), "payload_sha256", "payload")


def classify_rows(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Add validity to page rows: missing and invalid fields and the error text.

    All occurrences of an id repeated on its page are invalid. Pages are bounded by their
    requested length, so counting within (page, id) never meets a hot group.
    """
    required = sorted(set(required or R.REQUIRED_FIELDS))
    rows = rows.withColumn("_doc", F.try_parse_json("raw_row"))
    is_object = F.schema_of_variant("_doc").startswith("OBJECT")
    fields = F.map_keys(F.from_json("raw_row", "map<string,string>"))
    identity = F.try_variant_get("_doc", "$.id", "variant")
    id_type = F.schema_of_variant(identity)
    # A null stays null here, so that it is not counted as a repeated id.
    id_key = F.when(id_type != "VOID", F.concat_ws(":", id_type, F.to_json(identity)))
    out = rows.withColumns({
        "_object": F.coalesce(is_object, F.lit(False)), "_fields": fields,
        "_id": F.when(is_object, id_key), "package_id": F.when(is_object, F.to_json(identity))}
    ).drop("_doc")
    out = out.withColumn("package_id", F.when(F.col("package_id") != "null", F.col("package_id")))
    page = ["run_id", "page_start", "page_draw"]
    out = out.withColumn("_n", F.when(F.col("_id").isNotNull(), F.count("*").over(
        Window.partitionBy(*page, "_id"))))
    missing = F.array_except(F.array(*map(F.lit, required)), "_fields")
    has_null_id = F.array_contains("_fields", "id") & F.col("_id").isNull()
    position = F.col("row_index").cast("string")
    out = out.withColumn("missing_fields", F.when(F.col("_object"), missing).otherwise(
        F.array().cast("array<string>")))
    errors = F.when(~F.col("_object"), F.array(F.concat(
        F.lit("row "), position, F.lit(" is not an object")))).otherwise(F.array_compact(F.array(
            F.when(F.size("missing_fields") > 0, F.concat(
                F.lit("row "), position, F.lit(" is missing fields: "),
                F.array_join("missing_fields", ", "))),
            F.when(has_null_id, F.concat(F.lit("row "), position, F.lit(" has a null id"))),
            F.when(F.col("_n") > 1, F.concat(F.lit("row "), position,
                                             F.lit(" has a duplicate id: "),
                                             F.regexp_replace("package_id", '^"|"$', ""))))))
    invalid = F.when(~F.col("_object"), F.array(F.lit("row"))).when(
        has_null_id | (F.col("_n") > 1), F.array(F.lit("id"))).otherwise(
        F.array().cast("array<string>"))
    return out.withColumns({
        "invalid_fields": invalid, "validation_error": F.array_join(errors, "; "),
        "is_valid": F.size(errors) == 0}).drop("_object", "_fields", "_id", "_n")


def storage_rows(valid: DataFrame) -> DataFrame:
    """Canonical table row; ``coercion_error`` names the first value that does not fit exactly."""
    valid = valid.withColumn("_doc", F.try_parse_json("raw_row"))

    def value(name: str, kind: str) -> Column:
        return F.try_variant_get("_doc", f"$.{name}", kind)

    def text(name: str) -> Column:
        return value(name, "string")

    def whole(name: str) -> Column:
        number = value(name, "decimal(38,10)")
        return F.when(number == F.floor(number), number).try_cast("long")

    longs = {n: whole(n) for n in ("id", "idBulan", "idSatker")}
    pagu = value("pagu", "double")
    wrong = F.coalesce(*[F.when(text(n).isNotNull() & c.isNull(), F.lit(
        f"{n} is not an exact integer value")) for n, c in longs.items()],
        F.when(text("pagu").isNotNull() & pagu.isNull(), F.lit("pagu is not a number")))
    columns = {}
    for name in R.REQUIRED_FIELDS:
        if name == "pagu":
            columns[name] = pagu
        elif name == "idBulan":
            columns[name] = longs[name].try_cast("int")
        else:
            columns[name] = longs.get(name, text(name))
    carried = [c for c in ("run_id", "source_offset") if c in valid.columns]
    return valid.select(*carried, *[c.alias(n) for n, c in columns.items()],
                        wrong.alias("coercion_error"))


# ---- quarantine and provenance ---------------------------------------------------------------
def _page_identity() -> Column:
    return F.struct("run_id", "page_start", "requested_length", "page_draw", "payload_sha256")


def _content(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def quarantine_records(classified: DataFrame, captured_at: Column,
                       failure_evidence_path: Column) -> DataFrame:
    """Deterministic records of the invalid rows: ids and digests follow from the content."""
    rows = classified.where(~F.col("is_valid")).withColumns({
        "quarantine_record_version": F.lit(1), "page_identity": _page_identity(),
        "quarantine_record_id": digest_of(
            F.lit("1"), F.col("run_id"), F.col("page_start"), F.col("row_index"),
            F.col("payload_sha256")),
        "missing_fields": F.array_sort(F.array_distinct("missing_fields")),
        "invalid_fields": F.array_sort(F.array_distinct("invalid_fields")),
        "captured_at": captured_at, "failure_evidence_path": failure_evidence_path})
    kept = ["quarantine_record_version", "quarantine_record_id", "run_id", "page_identity",
            "source_offset", "page_start", "requested_length", "page_draw", "row_index",
            "package_id", "raw_row", "missing_fields", "invalid_fields", "validation_error",
            "captured_at", "payload_sha256", "failure_evidence_path"]
    return rows.select(*kept, _content(kept).alias("content_sha256"))


def provenance_records(classified: DataFrame, captured_at: Column) -> DataFrame:
    """One record per source offset, valid or not."""
    rows = classified.withColumns({
        "provenance_record_version": F.lit(1), "page_identity": _page_identity(),
        "provenance_record_id": digest_of(F.lit("1"), F.col("run_id"), F.col("source_offset")),
        "disposition": F.when(F.col("is_valid"), "canonical").otherwise("quarantine"),
        "row_sha256": F.sha2("raw_row", 256), "captured_at": captured_at})
    kept = ["provenance_record_version", "provenance_record_id", "run_id", "source_offset",
            "page_start", "requested_length", "page_draw", "row_index", "disposition",
            "package_id", "row_sha256", "payload_sha256", "page_identity", "captured_at"]
    return rows.select(*kept, _content(kept).alias("content_sha256"))


def record_violations(records: DataFrame, id_column: str) -> DataFrame:
    """Records whose stored digest, offset or page identity no longer agrees with their content."""
    content = [c for c in records.columns if c != "content_sha256"]
    identity = F.lit(True)
    for name in ("run_id", "page_start", "requested_length", "page_draw", "payload_sha256"):
        identity = identity & F.col(f"page_identity.{name}").eqNullSafe(F.col(name))
    checks = F.array_compact(F.array(
        F.when(_content(content) != F.col("content_sha256"), F.lit("content_sha256")),
        F.when(F.col("source_offset") != F.col("page_start") + F.col("row_index"),
               F.lit("source_offset")),
        F.when(F.col("row_index") >= F.col("requested_length"), F.lit("row_index")),
        F.when(~identity, F.lit("page_identity")),
        F.when(~F.col("payload_sha256").rlike(HEX64), F.lit("payload_sha256"))))
    return records.select(id_column, checks.alias("violations")).where(F.size("violations") > 0)


# ---- accounting ------------------------------------------------------------------------------
def page_accounting(classified: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Counts per page and running totals: source = canonical + quarantine at every page."""
    pages = classified.groupBy("run_id", "page_start").agg(
        F.count("*").alias("page_rows"), F.count_if("is_valid").alias("page_canonical"),
        F.count_if(~F.col("is_valid")).alias("page_quarantine"))
    totals = running(pages, ["run_id"], "page_start", sums={
        "source_rows_processed": F.col("page_rows"),
        "canonical_rows_collected": F.col("page_canonical"),
        "quarantine_rows": F.col("page_quarantine")}, block=block)
    return totals.withColumn("balanced", F.col("source_rows_processed") == F.col(
        "canonical_rows_collected") + F.col("quarantine_rows"))


def source_drift(pages: DataFrame) -> DataFrame:
    """Runs whose pages reported different source counts."""
    return pages.groupBy("run_id").agg(
        F.min("source_count").alias("lowest"), F.max("source_count").alias("highest")).where(
        "lowest <> highest")


def resume_state(checkpoint: DataFrame, canonical_rows: DataFrame, quarantine: DataFrame,
                 page_size: int) -> DataFrame:
    """Stored rows against the checkpoint of each run: consistent, one page ahead, or an error.

    ``checkpoint`` has run_id, canonical_rows_collected and quarantine_rows.
    """
    stored = canonical_rows.groupBy("run_id").agg(
        F.count("*").alias("stored_rows"), F.count_distinct("id").alias("distinct_ids"))
    held = quarantine.groupBy("run_id").agg(
        F.count_distinct("quarantine_record_id").alias("stored_quarantine"))
    zero = F.lit(0)
    j = checkpoint.join(stored, "run_id", "left").join(held, "run_id", "left").withColumns({
        "stored_rows": F.coalesce("stored_rows", zero),
        "distinct_ids": F.coalesce("distinct_ids", zero),
        "stored_quarantine": F.coalesce("stored_quarantine", zero)})
    ahead_rows = F.col("stored_rows") - F.col("canonical_rows_collected")
    ahead_quarantine = F.col("stored_quarantine") - F.col("quarantine_rows")
    ahead = ahead_rows + ahead_quarantine
    state = (
        F.when(F.col("distinct_ids") != F.col("stored_rows"), "error: duplicate canonical ids")
        .when(ahead_rows < 0, "error: canonical rows trail the checkpoint")
        .when(ahead_quarantine < 0, "error: quarantine trails the checkpoint")
        .when(ahead == 0, "consistent").when(ahead <= page_size, "replay_candidate")
        .otherwise("error: ahead by more than one page"))
    return j.select("run_id", ahead_rows.alias("canonical_ahead_count"),
                    ahead_quarantine.alias("quarantine_ahead_count"), state.alias("state"))


def verified_replay(states: DataFrame, page: DataFrame) -> DataFrame:
    """Runs whose surplus is exactly the replayed page; ``page`` has run_id and is_valid rows."""
    size = page.groupBy("run_id").agg(F.count_if("is_valid").alias("page_canonical"),
                                      F.count_if(~F.col("is_valid")).alias("page_quarantine"))
    j = states.join(size, "run_id")
    exact = ((F.col("state") == "replay_candidate")
             & (F.col("canonical_ahead_count") == F.col("page_canonical"))
             & (F.col("quarantine_ahead_count") == F.col("page_quarantine")))
    return j.withColumn("verified", exact)


# ---- hash-chained log ------------------------------------------------------------------------
PAYLOAD = """struct<start:bigint,page_size:bigint,returned_row_count:bigint,
canonical_row_count:bigint,quarantined_row_count:bigint,page_rows_digest:string,
source_count_observed:bigint,retry_index:bigint,processed:bigint,next_start:bigint,
last_completed_page:bigint,retries:bigint,canonical_total:bigint,quarantine_total:bigint,
quarantined_total:bigint,source_count_start:bigint,source_count_end:bigint,drift_status:string,
terminal_reason:string,promotion_flag:boolean,full_snapshot:boolean,duckdb_sha256:string,
checkpoint_snapshot:struct<source_rows_processed:bigint,next_start:bigint,
last_completed_page:bigint,retries_used:bigint,canonical_rows_collected:bigint,
quarantine_rows:bigint>>"""


def receipt_hash(previous_hash: Column) -> Column:
    """Hash of a receipt's fields over the hash of the one before."""
    return F.sha2(F.concat_ws("\u001f", "run_id", F.col("sequence").cast("string"),
                              "receipt_type", "timestamp", previous_hash, "payload"), 256)


def _prepare(log: DataFrame, block: int) -> DataFrame:
    rows = log.withColumn("p", F.from_json("payload", PAYLOAD))
    is_page = F.col("receipt_type") == "PAGE"

    def of_pages(name: str) -> Column:
        return F.when(is_page, F.col(f"p.{name}")).otherwise(0)

    page = F.when(is_page, F.struct(F.col("p.page_size").alias("page_size"),
                                    F.col("p.returned_row_count").alias("returned")))
    return running(
        rows, ["run_id"], "sequence", inclusive=False, block=block,
        sums={"prior_sizes": of_pages("page_size"),
              "prior_processed": of_pages("returned_row_count"),
              "prior_canonical": of_pages("canonical_row_count"),
              "prior_quarantine": of_pages("quarantined_row_count"),
              "prior_pages": is_page.cast("int"),
              "prior_retries": (F.col("receipt_type") == "RETRY").cast("int")},
        lasts={"before": F.struct("sequence", "hash", "receipt_type"), "prior_page": page})


def chain_violations(log: DataFrame, genesis: str = GENESIS, block: int = 1_000_000) -> DataFrame:
    """(run_id, rule) for every broken rule; a run without rows here is a valid chain.

    ``log``: run_id, sequence, receipt_type, timestamp, previous_hash, hash, payload (JSON text).
    Sequences are checked by prefix scans cut into blocks, so one long run stays distributed.
    """
    rows = _prepare(log, block)
    p, kind = F.col("p"), F.col("receipt_type")
    is_page, is_retry, is_resume = (kind == t for t in ("PAGE", "RETRY", "RESUME"))
    done = kind.isin(R.TERMINAL_TYPES)

    def ne(a: Column, b) -> Column:
        return ~a.eqNullSafe(b if isinstance(b, Column) else F.lit(b))

    snapshot = p["checkpoint_snapshot"]
    quarantined = F.coalesce(p["quarantine_total"], p["quarantined_total"])
    rules = {
        "invalid receipt_type": ~kind.isin(R.LOG_TYPES),
        "invalid timestamp": ~F.col("timestamp").rlike(
            r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
        | F.try_to_timestamp("timestamp").isNull(),
        "receipt hash mismatch": ne(F.col("hash"), receipt_hash(F.col("previous_hash"))),
        "receipt sequence mismatch": ne(F.col("sequence"),
                                        F.coalesce(F.col("before.sequence") + 1, F.lit(0))),
        "first receipt is not ANCHOR": F.col("before").isNull() & (kind != "ANCHOR"),
        "receipt previous_hash mismatch": ne(F.col("previous_hash"),
                                             F.coalesce(F.col("before.hash"), F.lit(genesis))),
        "receipt exists after terminal": F.col("before.receipt_type").isin(R.TERMINAL_TYPES),
        "PAGE accounting mismatch": is_page & ne(
            p["returned_row_count"], p["canonical_row_count"] + p["quarantined_row_count"]),
        "invalid page_rows_digest": is_page & ~F.coalesce(
            p["page_rows_digest"].rlike(HEX64), F.lit(False)),
        "PAGE offset discontinuity": is_page & ne(p["start"], F.col("prior_sizes")),
        "short PAGE before completion": is_page & F.col("prior_page").isNotNull() & ne(
            F.col("prior_page.returned"), F.col("prior_page.page_size")),
        "RETRY prefix binding mismatch": is_retry & ne(p["start"], F.col("prior_processed")),
        "RESUME prefix accounting mismatch": is_resume & (
            ne(p["processed"], F.col("prior_processed"))
            | ne(p["next_start"], F.col("prior_processed"))
            | ne(p["last_completed_page"], F.col("prior_pages"))
            | ne(p["retries"], F.col("prior_retries"))),
        "RESUME checkpoint snapshot mismatch": is_resume & (
            ne(snapshot["source_rows_processed"], F.col("prior_processed"))
            | ne(snapshot["next_start"], F.col("prior_processed"))
            | ne(snapshot["last_completed_page"], F.col("prior_pages"))
            | ne(snapshot["retries_used"], F.col("prior_retries"))),
        "RESUME checkpoint accounting mismatch": is_resume & (
            (snapshot["canonical_rows_collected"] != F.col("prior_canonical"))
            | (snapshot["quarantine_rows"] != F.col("prior_quarantine"))),
        "terminal accounting mismatch": done & ne(p["processed"],
                                                  p["canonical_total"] + quarantined),
        "invalid completion payload": (kind == "COMPLETION") & (
            ne(p["terminal_reason"], R.NORMAL_COMPLETION) | ne(p["promotion_flag"], False)
            | ne(p["drift_status"], R.NO_DRIFT)),
        "global accounting mismatch": (kind == "COMPLETION") & (
            ne(p["processed"], F.col("prior_processed"))
            | ne(p["canonical_total"], F.col("prior_canonical"))
            | ne(p["quarantine_total"], F.col("prior_quarantine"))),
        "invalid final PAGE size": done & F.col("prior_page").isNotNull() & ~(
            (F.col("prior_page.returned") > 0)
            & (F.col("prior_page.returned") <= F.col("prior_page.page_size"))),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n))
                                      for n, c in rules.items()]))
    by_row = rows.select("run_id", F.explode(named).alias("rule"))

    # Retries belong to the next page: everything between two pages shares prior_pages.
    span = rows.groupBy("run_id", "prior_pages").agg(
        F.count_if(is_retry).alias("retries"),
        F.sum(F.when(is_retry, p["retry_index"])).alias("index_sum"),
        F.count_distinct(F.when(is_retry, p["retry_index"])).alias("index_kinds"),
        F.max(F.when(is_retry, p["retry_index"])).alias("index_max"),
        F.min(F.when(is_retry, F.struct(p["start"], p["page_size"]))).alias("low"),
        F.max(F.when(is_retry, F.struct(p["start"], p["page_size"]))).alias("high"),
        F.max(F.when(is_page, F.struct(p["start"], p["page_size"]))).alias("page"),
        F.min(F.when(is_retry, F.col("sequence"))).alias("first_retry"),
        F.max(F.when(is_resume, F.col("sequence"))).alias("last_resume"),
        F.max(F.when(kind == "ABORT", 1)).alias("aborted")).where("retries > 0")
    retry_rules = {
        "RETRY prefix binding mismatch": (F.col("low") != F.col("high"))
        | (F.col("index_kinds") != F.col("retries")) | (F.col("index_max") != F.col("retries")),
        "RETRY does not bind to following PAGE": F.col("page").isNotNull()
        & (F.col("page") != F.col("low")),
        "RETRY is not followed by PAGE": F.col("last_resume") > F.col("first_retry"),
        "RETRY has no PAGE or ABORT outcome": F.col("page").isNull()
        & F.col("aborted").isNull(),
    }
    by_span = span.select("run_id", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in retry_rules.items()]))).alias(
        "rule"))

    facts = chain_facts(log)
    run_rules = {
        "receipt chain has no terminal receipt": ~F.col("terminal_type").isin(R.TERMINAL_TYPES),
        "source count accounting mismatch": F.col("completed") & (
            (F.col("pages") == 0) | ne(F.col("end.source_count_start"), F.col("first_source"))
            | ne(F.col("end.source_count_end"), F.col("last_source"))),
        "source count drift in COMPLETION chain": F.col("completed") & (
            F.col("low_source") != F.col("high_source")),
        "full snapshot source count mismatch": F.col("completed") & F.col("full_snapshot") & ne(
            F.col("end.source_count_end"), F.col("processed")),
    }
    by_run = facts.select("run_id", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in run_rules.items()]))).alias(
        "rule"))
    return by_row.unionByName(by_span).unionByName(by_run).distinct()


def chain_facts(log: DataFrame) -> DataFrame:
    """Totals and ends of every run, by plain aggregation."""
    rows = log.withColumn("p", F.from_json("payload", PAYLOAD))
    kind, seq = F.col("receipt_type"), F.col("sequence")
    is_page = kind == "PAGE"

    def page_sum(name: str) -> Column:
        return F.coalesce(F.sum(F.when(is_page, F.col(f"p.{name}"))), F.lit(0))

    def at(value: Column, pick) -> Column:
        return pick(value, F.when(is_page, seq))

    source = F.col("p.source_count_observed")
    return rows.groupBy("run_id").agg(
        F.max_by(kind, seq).alias("terminal_type"), F.max_by("hash", seq).alias("terminal_hash"),
        F.max_by("p", seq).alias("end"), F.count_if(is_page).alias("pages"),
        F.count_if(kind == "RETRY").alias("retry_total"),
        page_sum("returned_row_count").alias("processed"),
        page_sum("canonical_row_count").alias("canonical_total"),
        page_sum("quarantined_row_count").alias("quarantine_total"),
        at(source, F.min_by).alias("first_source"), at(source, F.max_by).alias("last_source"),
        F.min(F.when(is_page, source)).alias("low_source"),
        F.max(F.when(is_page, source)).alias("high_source"),
        F.max(F.when(kind == "ANCHOR", F.col("p.full_snapshot"))).alias("full_snapshot"),
    ).withColumn("completed", F.col("terminal_type") == "COMPLETION")


def verify_chains(log: DataFrame, genesis: str = GENESIS, block: int = 1_000_000) -> DataFrame:
    """One verdict per run; rule names are a fixed small set, so the list is bounded."""
    failures = chain_violations(log, genesis, block).groupBy("run_id").agg(
        F.array_sort(F.collect_set("rule")).alias("failures"))
    facts = chain_facts(log).select("run_id", "terminal_type", "terminal_hash", "processed",
                                    "canonical_total", "quarantine_total", "retry_total",
                                    "completed", "last_source",
                                    F.col("end.duckdb_sha256").alias("table_digest"))
    out = facts.join(failures, "run_id", "left").withColumn(
        "failures", F.coalesce("failures", F.array().cast("array<string>")))
    valid = F.size("failures") == 0
    return out.withColumn("valid", valid).withColumn(
        "promotion_valid", valid & F.col("completed")).drop("completed")


def append_receipts(log: DataFrame, drafts: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """Chain a short list of draft receipts (run_id, position, receipt_type, timestamp, payload)
    onto each run's head. A hash chain is sequential by definition; the drafts of one call are the
    receipts of one page step, so the fold per run is short.
    """
    heads = log.groupBy("run_id").agg(F.max("sequence").alias("last"),
                                      F.max_by("hash", "sequence").alias("head"))
    steps = drafts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "receipt_type", "timestamp", "payload"))).alias("steps")).join(
        heads, "run_id", "left")
    start = F.struct(F.coalesce("last", F.lit(-1)).cast("long").alias("sequence"),
                     F.coalesce("head", F.lit(genesis)).alias("hash"),
                     F.array().cast("array<struct<sequence:bigint,receipt_type:string,"
                                    "timestamp:string,previous_hash:string,payload:string,"
                                    "hash:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        seq = acc["sequence"] + 1
        h = F.sha2(F.concat_ws("\u001f", F.col("run_id"), seq.cast("string"), x["receipt_type"],
                               x["timestamp"], acc["hash"], x["payload"]), 256)
        row = F.struct(seq.alias("sequence"), x["receipt_type"].alias("receipt_type"),
                       x["timestamp"].alias("timestamp"), acc["hash"].alias("previous_hash"),
                       x["payload"].alias("payload"), h.alias("hash"))
        return F.struct(seq.alias("sequence"), h.alias("hash"),
                        F.concat(acc["done"], F.array(row)).alias("done"))

    folded = steps.select("run_id", F.explode(F.aggregate("steps", start, step)["done"]).alias(
        "r"))
    return folded.select("run_id", "r.*")


# ---- manifest, gates and selection -----------------------------------------------------------
def manifest_rows(facts: DataFrame, metrics: DataFrame, digest: DataFrame) -> DataFrame:
    """One row per run: chain totals with the table metrics and digest of that run."""
    return facts.join(metrics, "run_id").join(digest, "run_id")


MANIFEST_CHECKS = ["run_id", "table_name", "requested_limit", "full_snapshot",
                   "full_snapshot_target", "row_count", "distinct_id_count", "min_id", "max_id",
                   "sha256", "staging_only"]


def manifest_checks(manifest: str, observed: str, table_name: str) -> dict[str, Column]:
    """Named conditions of a manifest struct against the observed struct of the same run."""
    m, o = F.col(manifest), F.col(observed)
    return {
        "run_id": m["run_id"] == o["run_id"],
        "table_name": m["table_name"] == table_name,
        "requested_limit": m["requested_limit"] == o["row_count"],
        "full_snapshot": m["full_snapshot"].isNotNull(),
        "full_snapshot_target": ~m["full_snapshot"] | (
            m["source_records_filtered"] == o["row_count"]),
        "row_count": m["row_count"] == o["row_count"],
        "distinct_id_count": m["distinct_id_count"] == o["distinct_id_count"],
        "min_id": m["min_id"].eqNullSafe(o["min_id"]),
        "max_id": m["max_id"].eqNullSafe(o["max_id"]),
        "sha256": m["sha256"] == o["sha256"],
        "staging_only": ~m["promotion_eligible"] & (m["promotion_result"] == "not_in_scope"),
    }


COLLECTOR_CHECKS = ["response_shape", "requested_row_count", "sequential_pagination",
                    "source_count_consistency", "source_year_parameter", "non_null_ids",
                    "unique_ids", "database_read_only_reopen"]


def genesis_checks(manifest: str, observed: str, endpoint: str) -> dict[str, Column]:
    """Extra gates of a first snapshot: contract, source accounting, provenance, promotion state.

    ``manifest.validation`` maps every collector check to its verdict.
    """
    m, o = F.col(manifest), F.col(observed)
    source, size, pages = m["source_records_filtered"], m["page_size"], m["page_count"]
    names = F.array_sort(F.map_keys(m["validation"]))
    wanted = F.array(*map(F.lit, sorted(COLLECTOR_CHECKS)))
    started, ended = (F.try_to_timestamp(m[c]) for c in ("started_at", "collected_at"))
    return {
        "genesis_manifest_contract_valid": (m["manifest_version"] == 1)
        & (m["status"] == "validated_staging_sample") & m["full_snapshot"]
        & (m["promotion_result"] == "not_in_scope") & (names == wanted)
        & F.forall(F.map_values(m["validation"]), lambda v: v == "passed"),
        "genesis_full_source_accounting_valid": (source > 0) & (o["row_count"] == source),
        "genesis_collection_provenance_valid": (m["source_endpoint"] == endpoint)
        & (m["requested_year"] > 0) & (m["requested_limit"] == source) & (size > 0)
        & (pages == F.ceil(source / size)) & (m["request_count"] == pages)
        & (m["retries_used"] >= 0) & (started <= ended),
        "genesis_promotion_state_valid": ~m["promotion_eligible"],
    }


def promotion_gates(mode: str) -> list[str]:
    """Ordered gate names: 15 in steady state, 19 for the first snapshot."""
    if mode == "STEADY_STATE":
        return [*R.COMMON_GATES, *R.STEADY_GATES, R.FINAL_GATE]
    if mode == "GENESIS":
        return [*R.COMMON_GATES, *R.GENESIS_GATES, R.FINAL_GATE]
    raise ValueError(f"unknown promotion mode {mode!r}")


def gate_table(runs: DataFrame, mode: str) -> DataFrame:
    """(run_id, position, gate, verdict) from one boolean column per gate; null fails."""
    items = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(g).alias("gate"), F.when(
            F.coalesce(F.col(g), F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"))
        for i, g in enumerate(promotion_gates(mode))])
    return runs.select("run_id", F.explode(items).alias("g")).select("run_id", "g.*")


def promotion_verdict(gates: DataFrame) -> DataFrame:
    """Eligibility and the ordered failing gates per run (at most 19 names)."""
    failed = F.collect_list(F.when(F.col("verdict") == "FAIL", F.struct("position", "gate")))
    return gates.groupBy("run_id").agg(failed.alias("f")).select(
        "run_id", (F.size("f") == 0).alias("promotion_eligible"),
        F.transform(F.array_sort("f"), lambda x: x["gate"]).alias("failures"))


def select_snapshot(verdicts: DataFrame, order: str, expected_active: str | None,
                    current: DataFrame | None = None) -> DataFrame:
    """Newest eligible run becomes active, the one before it the rollback.

    ``current`` (active_run_id) holds the committed selection; a caller whose expectation is
    stale gets no row.
    """
    eligible = verdicts.where("promotion_eligible")
    newest = eligible.agg(F.max_by("run_id", order).alias("active_run_id"))
    if current is None:
        ok = F.lit(expected_active is None)
        out = newest.withColumn("rollback_run_id", F.lit(None).cast("string"))
    else:
        committed = current.select("active_run_id").scalar()
        out = newest.withColumn("rollback_run_id", committed)
        ok = F.col("rollback_run_id").eqNullSafe(F.lit(expected_active)) & (
            F.col("active_run_id") != F.col("rollback_run_id"))
    return out.where(ok & F.col("active_run_id").isNotNull())


def active_rows(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the selected run only."""
    return rows.join(selection.select(F.col("active_run_id").alias("run_id")), "run_id",
                     "left_semi")


# ---- failure audit ---------------------------------------------------------------------------
def missing_field_frequency(rows: DataFrame, required: list[str] | None = None) -> DataFrame:
    fields = F.map_keys(F.from_json("raw_row", "map<string,string>"))
    required = required or R.REQUIRED_FIELDS
    missing = F.array_except(F.array(*map(F.lit, sorted(required))), fields)
    return rows.select(F.explode(missing).alias("field")).groupBy("field").agg(
        F.count("*").alias("rows"))


def value_when_missing(rows: DataFrame, missing: str, shown: str) -> DataFrame:
    """Frequency of one field's value among the rows that lack another."""
    doc = F.from_json("raw_row", "map<string,string>")
    return rows.select(doc.alias("m")).where(
        F.col("m").isNotNull() & ~F.map_contains_key("m", missing)).groupBy(
        F.try_element_at("m", F.lit(shown)).alias("value")).agg(F.count("*").alias("rows"))


def repeated_ids(rows: DataFrame, location: list[str]) -> DataFrame:
    """Every occurrence of an id found more than once: one row each, never a list per id."""
    doc = F.from_json("raw_row", "map<string,string>")
    keyed = rows.select(*location, F.try_element_at(doc, F.lit("id")).alias("package_id")).where(
        "package_id is not null")
    counts = keyed.groupBy("package_id").agg(F.count("*").alias("occurrences")).where(
        "occurrences > 1")
    return keyed.join(counts, "package_id")
