"""Queries over outreach event logs derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumbung.plans.registry import query
from lumbung.plans.views import pick, table
from lumbung.operators import prospects
from lumbung.streaming import folds

BLOCK = 2_500  # small enough that the test tables span several blocks


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumns({
        "k": F.from_json("props", "struct<k:bigint>")["k"],
        "institution_id": F.concat(F.lit("inst-"), F.col("user_id").cast("string"))})


_E = """
 WITH RECURSIVE e AS (SELECT event_id AS seq, user_id, 'inst-' || user_id AS institution_id,
   event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"""


# ---- effective contact -----------------------------------------------------------------------
def override_events(spark, sf_dir):
    """Clicks and errors reject a contact, all other events answer with a replacement."""
    e = events(spark, sf_dir)
    rejects = F.col("event_type").isin("click", "error")
    k = F.col("k")
    return e.select(
        "institution_id", F.col("event_id").alias("seq"),
        F.when(rejects, "MISMATCH").otherwise("REPLACEMENT").alias("type"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("mismatch_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("replacement_id"),
        F.concat(F.lit("fp"), (k % 4).cast("string")).alias("rejected_fingerprint"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("parent_mismatch_id"),
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("@x.id")).alias("email"),
        F.lit("https://x.id/r").alias("evidence_url"),
        F.concat(F.lit("fp"), (k % 4).cast("string")).alias("fingerprint"))


def canonical(spark, sf_dir):
    return events(spark, sf_dir).select("institution_id", "user_id").distinct().select(
        "institution_id", F.lit("c@x.id").alias("email"), F.lit("https://x.id/c").alias(
            "source_url"), F.when(F.col("user_id") % 10 != 0, "fp0").alias("fingerprint"))


_WALK = _E + """,
 n AS (SELECT institution_id, seq, event_type IN ('click', 'error') AS rejects,
   CASE WHEN event_type IN ('click', 'error') THEN 'F:fp' || (k % 4) ELSE 'M:m' || (k % 3) END
     AS takes,
   CASE WHEN event_type IN ('click', 'error') THEN 'M:m' || (k % 3) ELSE 'F:fp' || (k % 4) END
     AS gives FROM e),
 s AS (SELECT DISTINCT institution_id, -1 AS seq, FALSE AS rejects, 'F:fp0' AS gives FROM e
       WHERE user_id % 10 <> 0),
 a AS (SELECT institution_id, seq, rejects, gives FROM n UNION ALL SELECT * FROM s),
 l AS (SELECT a.institution_id, a.seq, min(n.seq) AS nxt FROM a JOIN n ON
   a.institution_id = n.institution_id AND a.gives = n.takes AND n.seq > a.seq GROUP BY 1, 2),
 w AS (SELECT institution_id, CAST(-1 AS BIGINT) AS seq FROM s UNION ALL
   SELECT w.institution_id, l.nxt FROM w JOIN l ON w.institution_id = l.institution_id
     AND w.seq = l.seq),
 z AS (SELECT institution_id, max(seq) AS seq FROM w GROUP BY 1),
 eff AS (SELECT z.institution_id, CASE WHEN z.seq = -1 THEN 'CANONICAL' ELSE 'REPLACEMENT' END
   AS kind, CASE WHEN z.seq = -1 THEN 'c@x.id' ELSE 'e' || z.seq || '@x.id' END AS email
   FROM z JOIN a ON a.institution_id = z.institution_id AND a.seq = z.seq WHERE NOT rejects)"""


@query("effective_contact", _WALK + " SELECT institution_id, kind, email FROM eff")
def effective_contact(spark, sf_dir):
    return folds.effective_contact(override_events(spark, sf_dir), canonical(spark, sf_dir),
                                   block=BLOCK).select("institution_id", "kind", "email")


@query("effective_contact_applied", _WALK + """
 SELECT i.institution_id, coalesce(email, 'own@x.id') AS contact_email,
  CASE WHEN kind = 'REPLACEMENT' THEN 'CONTACT_FOUND' ELSE 'CONTACT_MISSING' END
   AS contact_status FROM (SELECT DISTINCT institution_id FROM e) i
 LEFT JOIN eff ON eff.institution_id = i.institution_id""")
def effective_contact_applied(spark, sf_dir):
    current = folds.effective_contact(override_events(spark, sf_dir), canonical(spark, sf_dir),
                                      block=BLOCK)
    rows = events(spark, sf_dir).select("institution_id").distinct().select(
        "institution_id", F.lit("own@x.id").alias("contact_email"),
        F.lit("").alias("contact_source_url"), F.lit("CONTACT_MISSING").alias("contact_status"))
    return prospects.apply_effective(rows, current).select(
        "institution_id", "contact_email", "contact_status")


@query("open_mismatch", _E + """,
 m AS (SELECT institution_id, max(seq) AS seq, 'm' || (arg_max(k, seq) % 3) AS mismatch_id
       FROM e WHERE event_type IN ('click', 'error') GROUP BY 1)
 SELECT institution_id, seq, mismatch_id FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE
   e.institution_id = m.institution_id AND event_type NOT IN ('click', 'error')
   AND e.seq > m.seq AND 'm' || (k % 3) = m.mismatch_id)""")
def open_mismatch(spark, sf_dir):
    return folds.open_mismatches(override_events(spark, sf_dir)).select(
        "institution_id", "seq", "mismatch_id")


# ---- timeline --------------------------------------------------------------------------------
def timeline_commands(spark, sf_dir):
    return events(spark, sf_dir).select(
        "institution_id", F.col("event_id").alias("seq"),
        pick(["FOLLOW_UP_1", "FOLLOW_UP_2", "PHONE_CALL", "MEETING", "QUOTATION"],
             F.col("k")).alias("event"),
        F.when(F.col("event_type").isin("error", "view"), "reset").otherwise("complete").alias(
            "operation"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("ts"),
        F.col("event_type").alias("actor"))


_TIME = _E + """,
 c AS (SELECT institution_id, seq, ['FOLLOW_UP_1', 'FOLLOW_UP_2', 'PHONE_CALL', 'MEETING',
   'QUOTATION'][1 + CAST(k % 5 AS INTEGER)] AS event, event_type NOT IN ('error', 'view')
   AS done FROM e),
 p AS (SELECT *, coalesce(lag(done) OVER (PARTITION BY institution_id, event ORDER BY seq),
   FALSE) AS was FROM c),
 x AS (SELECT * FROM p WHERE done <> was),
 f AS (SELECT institution_id, event, arg_max(done, seq) AS done, max(seq) AS seq FROM x
       GROUP BY 1, 2)"""


@query("event_fold_latest", _TIME + """
 SELECT institution_id, string_agg(CASE WHEN done THEN event || '@t' || seq END, ';'
   ORDER BY seq) AS completed, 't' || max(seq) AS updated_at,
  CASE WHEN bool_or(done AND event = 'QUOTATION') THEN 'Penawaran'
   WHEN bool_or(done AND event = 'MEETING') THEN 'Meeting'
   WHEN bool_or(done AND event = 'PHONE_CALL') THEN 'Telepon'
   WHEN bool_or(done AND event = 'FOLLOW_UP_2') THEN 'Tindak Lanjut 2'
   WHEN bool_or(done AND event = 'FOLLOW_UP_1') THEN 'Tindak Lanjut 1'
   ELSE 'Belum ada aktivitas CRM' END AS current_stage FROM f GROUP BY 1""")
def event_fold_latest(spark, sf_dir):
    state = folds.timeline_state(timeline_commands(spark, sf_dir), block=BLOCK)
    shown = F.array_join(F.transform("completed_events", lambda e: F.concat(
        e, F.lit("@"), F.element_at("event_timestamps", e))), ";")
    return state.select("institution_id", F.nullif(shown, F.lit("")).alias("completed"),
                        "updated_at", "current_stage")


@query("timeline_counts", _TIME + """,
 i AS (SELECT DISTINCT institution_id, user_id % 4 = 0 AS sent FROM e),
 ev AS (SELECT institution_id, event FROM f WHERE done UNION SELECT institution_id, unnest([
   'COLD_EMAIL_DRAFTED', 'DRAFT_APPROVED', 'EMAIL_SENT']) FROM i WHERE sent)
 SELECT p AS position, n AS event, count(ev.institution_id) AS institutions FROM (VALUES
  (0, 'COLD_EMAIL_DRAFTED'), (1, 'DRAFT_APPROVED'), (2, 'EMAIL_SENT'), (3, 'FOLLOW_UP_1'),
  (4, 'FOLLOW_UP_2'), (5, 'PHONE_CALL'), (6, 'MEETING'), (7, 'QUOTATION'), (8, 'CLOSED_WON'),
  (9, 'CLOSED_LOST')) v(p, n) LEFT JOIN ev ON event = n GROUP BY 1, 2""")
def timeline_counts(spark, sf_dir):
    state = folds.timeline_state(timeline_commands(spark, sf_dir), block=BLOCK)
    rows = events(spark, sf_dir).select("institution_id", F.when(
        F.col("user_id") % 4 == 0, "SENT").otherwise("NOT_CONTACTED").alias(
        "outreach_status")).distinct()
    joined = rows.join(state.select("institution_id", F.col("completed_events").alias(
        "recorded_events")), "institution_id", "left")
    return prospects.timeline_counts(joined).select("position", "event", "institutions")


# ---- drafts ----------------------------------------------------------------------------------
def draft_commands(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select(
        "institution_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "APPROVED").when(
            F.col("event_type") == "purchase", "READY_TO_SEND").when(
            F.col("event_type") == "signup", "SENT").when(k % 2 == 0, "UNDER_REVIEW").alias(
            "status"),
        F.when(k % 7 == 0, "").when(k % 5 < 2, F.concat(F.lit("text "), (k % 3).cast(
            "string"))).alias("text"),
        F.lit(None).cast("string").alias("review_status"), F.lit(None).cast("boolean").alias(
            "sent"), F.lit("op").alias("actor"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("ts"))


_DRAFT = _E + """,
 c AS (SELECT institution_id, seq, CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'R'
   WHEN 'signup' THEN 'S' ELSE 'P' END AS kind, CASE WHEN k % 7 = 0 THEN '' WHEN k % 5 < 2 THEN
   'text ' || (k % 3) END AS text FROM e),
 o AS (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY seq) AS rn FROM c),
 w(institution_id, rn, seq, body, approved, ready, version, code) AS (
  SELECT institution_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', FALSE, FALSE, 0,
    CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT institution_id FROM c)
  UNION ALL
  SELECT w.institution_id, o.rn, o.seq,
   CASE WHEN kind IN ('S', 'R') OR (kind = 'A' AND trim(coalesce(text, body)) = '') THEN body
     ELSE coalesce(text, body) END,
   CASE WHEN kind = 'A' AND trim(coalesce(text, body)) <> '' THEN TRUE
     WHEN kind = 'P' AND coalesce(text, body) <> body THEN FALSE ELSE approved END,
   CASE WHEN kind = 'A' AND trim(coalesce(text, body)) <> '' THEN FALSE
     WHEN kind = 'R' AND approved AND coalesce(text, body) = body THEN TRUE
     WHEN kind = 'P' AND coalesce(text, body) <> body THEN FALSE ELSE ready END,
   version + CASE WHEN (kind = 'P' OR (kind = 'A' AND trim(coalesce(text, body)) <> ''))
     AND coalesce(text, body) <> body THEN 1 ELSE 0 END,
   CASE WHEN kind = 'S' THEN 'FINAL_STATE_SERVER_ONLY'
     WHEN kind = 'A' AND trim(coalesce(text, body)) = '' THEN 'DRAFT_REQUIRED'
     WHEN kind = 'R' AND (NOT approved OR coalesce(text, body) <> body) THEN 'APPROVAL_REQUIRED'
     END
  FROM w JOIN o ON o.institution_id = w.institution_id AND o.rn = w.rn + 1)"""


@query("draft_lifecycle", _DRAFT + """
 SELECT institution_id, seq, body AS text, approved, ready AS ready_to_send, version,
  code AS rejection FROM w WHERE rn > 0""")
def draft_lifecycle(spark, sf_dir):
    return folds.draft_history(draft_commands(spark, sf_dir), block=BLOCK).select(
        "institution_id", "seq", "text", "approved", "ready_to_send", "version", "rejection")


@query("draft_state", _DRAFT + """
 SELECT institution_id, arg_max(body, rn) AS text, arg_max(approved, rn) AS approved,
  arg_max(version, rn) AS version FROM w GROUP BY 1""")
def draft_state(spark, sf_dir):
    return folds.draft_state(draft_commands(spark, sf_dir), block=BLOCK).select(
        "institution_id", "text", "approved", "version")


# ---- commands, outcomes, attempts, verifications ---------------------------------------------
@query("idempotent_commands", _E + """,
 c AS (SELECT seq, 'c' || (seq // 3) AS command_id, k % 2 AS body FROM e),
 f AS (SELECT command_id, min(seq) AS s, arg_min(body, seq) AS b FROM c GROUP BY 1)
 SELECT seq, CASE WHEN seq = s THEN 'created' WHEN body = b THEN 'replayed' ELSE 'conflict' END
  AS verdict FROM c JOIN f USING (command_id)""")
def idempotent_commands(spark, sf_dir):
    return folds.idempotent_commands(command_rows(spark, sf_dir)).select("seq", "verdict")


def command_rows(spark, sf_dir):
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.floor(
            F.col("event_id") / 3).cast("string")).alias("command_id"),
        (F.col("k") % 2).cast("string").alias("canonical_content"))


@query("latest_outcome", _E + """
 SELECT institution_id, arg_max(event_type, seq) AS outcome FROM e WHERE k % 3 = 0 GROUP BY 1""")
def latest_outcome(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "institution_id", F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"),
        F.when(F.col("k") % 3 != 0, "p").alias("procurement_id"))
    return folds.latest_generic_outcomes(rows).select("institution_id", "outcome")


def send_log(spark, sf_dir):
    return events(spark, sf_dir).select(
        F.col("institution_id").alias("idempotency_key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "FINALIZE").otherwise("REQUEST").alias("action"),
        F.when(F.col("event_type") != "error", "reserved").when(
            F.col("k") < 90, "failed").otherwise("sent").alias("status"))


_SEND = _E + """,
 l AS (SELECT institution_id, seq, event_type = 'error' AS fin, k < 90 AS failed,
   lag(event_type = 'error' AND k < 90) OVER (PARTITION BY institution_id ORDER BY seq)
     AS prev FROM e),
 q AS (SELECT *, NOT fin AND coalesce(prev, TRUE) AS accepted FROM l),
 r AS (SELECT *, sum(CAST(accepted AS INTEGER)) OVER (PARTITION BY institution_id ORDER BY seq)
       AS n FROM q)"""


@query("attempt_numbering", _SEND + """
 SELECT seq, accepted, CASE WHEN accepted THEN n END AS attempt_number FROM r WHERE NOT fin""")
def attempt_numbering(spark, sf_dir):
    return folds.numbered_attempts(send_log(spark, sf_dir), block=BLOCK).select(
        "seq", "accepted", "attempt_number")


@query("attempt_status", _SEND + """
 SELECT institution_id AS idempotency_key, CAST(n AS BIGINT) AS attempt_number,
  coalesce(arg_max(CASE WHEN failed THEN 'failed' ELSE 'sent' END, CASE WHEN fin THEN seq END),
   'reserved') AS status FROM r WHERE n > 0 GROUP BY 1, 2""")
def attempt_status(spark, sf_dir):
    return folds.finalized_attempts(send_log(spark, sf_dir), block=BLOCK).select(
        "idempotency_key", "attempt_number", "status")


@query("current_verification", _E + """,
 p AS (SELECT institution_id, seq, k % 3 AS fp, lag(k % 3) OVER (PARTITION BY institution_id
   ORDER BY seq) AS prev FROM e)
 SELECT institution_id, max(seq) AS seq FROM p WHERE prev IS DISTINCT FROM fp GROUP BY 1""")
def current_verification(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "institution_id", F.col("event_id").alias("seq"),
        (F.col("k") % 3).cast("string").alias("evidence_fingerprint"))
    return folds.current_verifications(rows, block=BLOCK).select("institution_id", "seq")


@query("workflow_state", _E + """
 SELECT institution_id, coalesce(arg_max('a' || k, CASE WHEN event_type = 'view' THEN seq END),
  'Call Again') AS action, arg_max(CAST(value AS VARCHAR), CASE WHEN event_type = 'click' THEN seq
  END) AS note FROM e GROUP BY 1""")
def workflow_state(spark, sf_dir):
    patches = events(spark, sf_dir).select(
        "institution_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("a"), F.col("k").cast(
            "string"))).alias("nextAction__action"),
        F.when(F.col("event_type") == "click", F.col("value").cast("string")).alias(
            "nextAction__note"))
    state = folds.workflow_state(patches, {"nextAction__action": F.lit("Call Again")},
                                 {"nextAction": ["action", "note"]})
    return state.select("institution_id", "nextAction.action", "nextAction.note")
