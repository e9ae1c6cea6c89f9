"""Append-only event logs folded into current state, as batch jobs.

Every log has an integer ``seq`` giving the event order. No fold collects the events of a long
history: each is a prefix scan, an aggregation or a walk along links between events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.functions.ranking import one_per_group
from lumbung.operators.scan import BLOCK_ROWS, by_length, previous, running
from lumbung.rules import outreach as R
from lumbung.session import cut_lineage

FOLDED = 10_000  # events of an institution that are folded one after the other


# ---- effective contact -----------------------------------------------------------------------
def _contact_nodes(events: DataFrame, canonical: DataFrame) -> DataFrame:
    """Events as nodes: what state each one waits for (``takes``) and which it leaves (``gives``).

    The canonical contact is a start node before all events. A mismatch takes the contact with the
    fingerprint it rejects and leaves a wait for its replacement; a replacement takes that wait and
    leaves a contact with its own fingerprint.
    """
    start = canonical.where(F.col("fingerprint").isNotNull()).select(
        "institution_id", F.lit(-1).cast("long").alias("seq"),
        F.lit(None).cast("string").alias("takes"),
        F.concat(F.lit("F:"), "fingerprint").alias("gives"),
        F.struct("email", "source_url", "fingerprint", F.lit("CANONICAL").alias("kind"),
                 F.lit(None).cast("string").alias("replacement_id")).alias("contact"))
    rejects = F.col("type") == "MISMATCH"
    moves = events.select(
        "institution_id", F.col("seq").cast("long").alias("seq"),
        F.when(rejects, F.concat(F.lit("F:"), "rejected_fingerprint")).otherwise(
            F.concat(F.lit("M:"), "parent_mismatch_id")).alias("takes"),
        F.when(rejects, F.concat(F.lit("M:"), "mismatch_id")).otherwise(
            F.concat(F.lit("F:"), "fingerprint")).alias("gives"),
        F.when(~rejects, F.struct(
            "email", F.col("evidence_url").alias("source_url"), "fingerprint",
            F.lit("REPLACEMENT").alias("kind"), "replacement_id")).alias("contact"))
    return start.unionByName(moves)


def effective_contact(events: DataFrame, canonical: DataFrame, block: int = BLOCK_ROWS,
                      folded: int = FOLDED) -> DataFrame:
    """Current contact per institution; institutions with none in force are absent.

    Only the first event after a node that takes what the node gives can follow it, so the history
    in force is a chain of links. A history of at most ``folded`` events is walked in order; the
    ends of longer ones are found by pointer doubling.

    ``canonical``: institution_id, email, source_url, fingerprint (null: no usable contact), one
    row per institution.
    """
    nodes = _contact_nodes(events, canonical)
    short, longer = by_length(nodes, ["institution_id"], folded)
    walked = _walked(short)
    return walked if longer is None else walked.unionByName(_doubled(longer, block))


def _walked(nodes: DataFrame) -> DataFrame:
    """Each institution's nodes in order, keeping the one in force."""
    node = F.struct("seq", "takes", "gives", "contact")
    none = F.lit(None).cast(nodes.select(node.alias("n")).schema["n"].dataType)
    steps = nodes.groupBy("institution_id").agg(F.array_sort(F.collect_list(node)).alias("steps"))
    end = F.aggregate("steps", none, lambda held, n: F.when(
        (n["seq"] == -1) | (n["takes"] == held["gives"]), n).otherwise(held))
    return steps.select("institution_id", end["contact"].alias("contact")).where(
        F.col("contact").isNotNull()).select("institution_id", "contact.*")


def _doubled(nodes: DataFrame, block: int) -> DataFrame:
    """The links of all nodes are squared until nothing moves, which takes log2(longest chain)
    joins however long one institution's history is. Each round is written out, so the plan does
    not grow.
    """
    # For every node the next node (in seq order) that takes its key: a scan in reverse order.
    gives = nodes.where(F.col("gives").isNotNull()).select(
        "institution_id", F.col("gives").alias("key"), (-2 * F.col("seq")).alias("at"),
        F.col("seq").alias("from_seq"), F.lit(None).cast("long").alias("takes_at"))
    takes = nodes.where(F.col("takes").isNotNull()).select(
        "institution_id", F.col("takes").alias("key"), (-2 * F.col("seq") + 1).alias("at"),
        F.lit(None).cast("long").alias("from_seq"), F.col("seq").alias("takes_at"))
    scanned = running(gives.unionByName(takes), ["institution_id", "key"], "at",
                      lasts={"next_seq": F.col("takes_at")}, inclusive=False, block=2 * block)
    links = scanned.where(F.col("from_seq").isNotNull()).select(
        "institution_id", F.col("from_seq").alias("node"),
        F.coalesce("next_seq", "from_seq").alias("jump"))
    links = cut_lineage(links)
    while True:
        ahead = links.select("institution_id", F.col("node").alias("jump"),
                             F.col("jump").alias("further"))
        stepped = cut_lineage(links.join(ahead, ["institution_id", "jump"], "left").select(
            "institution_id", "node", F.col("jump").alias("before"),
            F.coalesce("further", "jump").alias("jump")))
        moved = not stepped.where("before <> jump").isEmpty()
        links = stepped.drop("before")
        if not moved:
            break
    ends = links.where("node = -1").select("institution_id", F.col("jump").alias("seq"))
    return nodes.join(ends, ["institution_id", "seq"]).where(
        F.col("contact").isNotNull()).select("institution_id", "contact.*")


def open_mismatches(events: DataFrame) -> DataFrame:
    """The latest mismatch of each institution if no later replacement answers it."""
    mismatches = events.where("type = 'MISMATCH'")
    latest = one_per_group(mismatches, ["institution_id"], F.col("seq"), largest=True)
    answers = events.where("type = 'REPLACEMENT'").groupBy(
        "institution_id", F.col("parent_mismatch_id").alias("mismatch_id")).agg(
        F.max("seq").alias("_answered"))
    j = latest.join(answers, ["institution_id", "mismatch_id"], "left")
    return j.where(F.col("_answered").isNull() | (F.col("_answered") < F.col("seq"))).select(
        *events.columns)


# ---- timeline --------------------------------------------------------------------------------
def timeline_changes(commands: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Commands that change something: repeats of complete or reset are no-ops."""
    manual = commands.where(F.col("event").isin(R.MANUAL_EVENTS)
                            & F.col("operation").isin("complete", "reset"))
    stepped = previous(manual, ["institution_id", "event"], "seq", ["operation"], block=block)
    was_done = F.coalesce(F.col("previous.operation") == "complete", F.lit(False))
    return stepped.where((F.col("operation") == "complete") != was_done).drop("previous")


def timeline_state(commands: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Completed manual events with their times, stage label and last change per institution."""
    changes = timeline_changes(commands, block)
    per_event = changes.groupBy("institution_id", "event").agg(
        F.max_by(F.struct("operation", "ts", "seq", "actor"), "seq").alias("last"))
    done = F.col("last.operation") == "complete"
    entry = F.when(done, F.struct(F.col("last.seq").alias("seq"), "event",
                                  F.col("last.ts").alias("ts")))
    # At most one entry per manual event and institution.
    out = per_event.groupBy("institution_id").agg(
        F.array_sort(F.collect_list(entry)).alias("done"),
        F.max_by(F.struct(F.col("last.ts").alias("ts"), F.col("last.actor").alias("actor")),
                 "last.seq").alias("change"))
    events = F.transform("done", lambda d: d["event"])
    labels = dict(R.TIMELINE_EVENTS)
    stage = F.coalesce(*[F.when(F.array_contains(events, k), F.lit(labels[k]))
                         for k in reversed(R.MANUAL_EVENTS)], F.lit(R.NO_TIMELINE_LABEL))
    return out.select(
        "institution_id", events.alias("completed_events"),
        F.map_from_entries(F.transform("done", lambda d: F.struct(d["event"], d["ts"]))).alias(
            "event_timestamps"),
        stage.alias("current_stage"), F.col("change.ts").alias("updated_at"),
        F.col("change.actor").alias("updated_by"))


# ---- draft lifecycle -------------------------------------------------------------------------
def draft_history(commands: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """State after every draft command and whether it was accepted.

    ``commands``: institution_id, seq, status, text, review_status, sent, actor, ts. The text in
    force depends on earlier accepted texts only, approval on text changes, readiness on approval;
    so three prefix scans replace the command-by-command fold.
    """
    short, longer = by_length(commands, ["institution_id"], block)
    done = _draft_scans(short, None)
    return done if longer is None else done.unionByName(_draft_scans(longer, block))


def _draft_scans(commands: DataFrame, block: int | None) -> DataFrame:
    key, status = ["institution_id"], F.col("status")
    server_only = F.coalesce(status == "SENT", F.lit(False)) | F.coalesce("sent", F.lit(False))
    ready = F.coalesce(status == "READY_TO_SEND", F.lit(False)) & ~server_only
    approve = F.coalesce(status == "APPROVED", F.lit(False)) & ~server_only
    df = commands.withColumns({"_server": server_only, "_ready": ready, "_approve": approve})

    # Text: set by every accepted command that carries one; readiness never sets it.
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    sets = F.col("text").isNotNull() & ~F.col("_server") & ~F.col("_ready") & ~(
        F.col("_approve") & blank)
    df = df.withColumn("_set", F.when(sets, F.col("text")))
    df = running(df, key, "seq", lasts={"_before": F.col("_set")}, inclusive=False, block=block)
    before = F.coalesce("_before", F.lit(""))
    wanted = F.coalesce(F.col("text"), before)
    df = df.withColumns({"_wanted": wanted, "_changed": wanted != before})
    no_text = F.col("_approve") & (F.trim("_wanted") == "")

    # Approval: given by an approval, taken by a changed text.
    plain = ~F.col("_server") & ~F.col("_ready") & ~F.col("_approve")
    approval = F.when(F.col("_approve") & ~no_text, F.struct(
        F.lit(True).alias("on"), F.col("actor").alias("by"), F.col("ts").alias("at"))).when(
        plain & F.col("_changed"), F.struct(
            F.lit(False).alias("on"), F.lit(None).cast("string").alias("by"),
            F.lit(None).cast("string").alias("at")))
    df = df.withColumns({"_no_text": no_text, "_plain": plain, "_approval": approval})
    df = running(df, key, "seq", lasts={"_had": F.col("_approval")}, inclusive=False, block=block)
    denied = F.col("_ready") & (~F.coalesce(F.col("_had.on"), F.lit(False))
                                | F.col("_had.by").isNull() | F.col("_had.at").isNull()
                                | F.col("_changed"))
    code = (F.when(F.col("_server"), "FINAL_STATE_SERVER_ONLY")
            .when(F.col("_no_text"), "DRAFT_REQUIRED").when(denied, "APPROVAL_REQUIRED"))
    df = df.withColumn("rejection", code).withColumn("_ok", F.col("rejection").isNull())
    accepted, ok_ready = F.col("_ok"), F.col("_ready") & F.col("_ok")
    ok_approve = F.col("_approve") & F.col("_ok")

    shown = F.when(accepted & (F.col("_approve") | F.col("_ready")), status).when(
        accepted, F.coalesce(status, F.when(F.col("_changed"), "EDITED")))
    review = F.when(ok_approve, "Approved").when(ok_ready, "Ready to Send").when(
        accepted & F.col("review_status").isNotNull(), F.col("review_status")).when(
        accepted, shown)
    flag = F.when(ok_ready, True).when(ok_approve | (
        F.col("_plain") & F.col("_changed")), False)
    bumped = accepted & ~F.col("_ready") & F.col("_changed")
    df = running(
        df, key, "seq", block=block,
        sums={"version": bumped.cast("long")},
        lasts={"_status": shown, "_review": review, "_flag": flag, "_text": F.col("_set"),
               "_app": F.col("_approval"), "_at": F.when(accepted, F.col("ts"))})
    # A plain command without status or change repeats the status in force as its review text.
    return df.select(
        "institution_id", "seq", "rejection",
        F.coalesce("_text", F.lit("")).alias("text"),
        F.coalesce("_status", F.lit("NOT_GENERATED")).alias("status"),
        F.coalesce("_review", F.lit("Not Generated")).alias("review_status"),
        F.coalesce("_app.on", F.lit(False)).alias("approved"),
        F.coalesce("_flag", F.lit(False)).alias("ready_to_send"), F.lit(False).alias("sent"),
        F.col("_at").alias("updated_at"), "version", F.col("_app.by").alias("approved_by"),
        F.col("_app.at").alias("approved_at"))


def draft_state(commands: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    return one_per_group(draft_history(commands, block), ["institution_id"], F.col("seq"),
                         largest=True).drop("seq", "rejection")


# ---- commands, outcomes, attempts ------------------------------------------------------------
def idempotent_commands(commands: DataFrame) -> DataFrame:
    """created / replayed / conflict per command row, by command id and content."""
    first = commands.groupBy("command_id").agg(
        F.min("seq").alias("_seq"), F.min_by("canonical_content", "seq").alias("_content"))
    j = commands.join(first, "command_id")
    verdict = (F.when(F.col("seq") == F.col("_seq"), "created")
               .when(F.col("canonical_content") == F.col("_content"), "replayed")
               .otherwise("conflict"))
    return j.withColumn("verdict", verdict).drop("_seq", "_content")


def latest_generic_outcomes(outcomes: DataFrame) -> DataFrame:
    """Newest outcome per institution that is not tied to a procurement."""
    return one_per_group(outcomes.where(F.col("procurement_id").isNull()), ["institution_id"],
                         F.col("seq"), largest=True)


def numbered_attempts(log: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Send requests with acceptance and attempt number.

    ``log``: idempotency_key, seq, action (REQUEST / FINALIZE), status. A request is blocked while
    an earlier attempt is reserved or sent; only a failed one frees the key again.
    """
    stepped = previous(log, ["idempotency_key"], "seq", ["action", "status"], block=block)
    free = F.col("previous").isNull() | (
        (F.col("previous.action") == "FINALIZE") & (F.col("previous.status") == "failed"))
    marked = stepped.withColumn("accepted", (F.col("action") == "REQUEST") & free)
    counted = running(marked, ["idempotency_key"], "seq",
                      sums={"_n": F.col("accepted").cast("long")}, block=block)
    return counted.where("action = 'REQUEST'").withColumn(
        "attempt_number", F.when(F.col("accepted"), F.col("_n"))).drop("previous", "_n", "action")


def finalized_attempts(log: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Accepted attempts with their last finalisation; an open one stays reserved."""
    stepped = previous(log, ["idempotency_key"], "seq", ["action", "status"], block=block)
    free = F.col("previous").isNull() | (
        (F.col("previous.action") == "FINALIZE") & (F.col("previous.status") == "failed"))
    marked = stepped.withColumn("_accepted", (F.col("action") == "REQUEST") & free)
    grouped = running(marked, ["idempotency_key"], "seq",
                      sums={"attempt_number": F.col("_accepted").cast("long")}, block=block)
    is_patch = F.col("action") == "FINALIZE"
    return grouped.where("attempt_number > 0").groupBy("idempotency_key", "attempt_number").agg(
        F.coalesce(F.max_by("status", F.when(is_patch, F.col("seq"))), F.lit("reserved")).alias(
            "status"),
        F.min(F.when(F.col("_accepted"), F.col("seq"))).alias("reserved_seq"))


def current_verifications(records: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Newest verification per institution; a repeat of the same fingerprint keeps the earlier."""
    stepped = previous(records, ["institution_id"], "seq", ["evidence_fingerprint"], block=block)
    changed = stepped.where(F.col("previous").isNull() | ~F.col(
        "previous.evidence_fingerprint").eqNullSafe(F.col("evidence_fingerprint")))
    return one_per_group(changed.drop("previous"), ["institution_id"], F.col("seq"),
                         largest=True)


def workflow_state(patches: DataFrame, defaults: dict[str, Column], groups: dict[str, list[str]]
                   ) -> DataFrame:
    """Partial patches merged over defaults: per field the newest non-null value.

    ``groups`` maps a group name to its fields; patch columns are named ``group__field``.
    """
    fields = [f"{g}__{f}" for g, names in groups.items() for f in names]
    newest = patches.groupBy("institution_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields])

    def value(name: str) -> Column:
        return F.coalesce(name, defaults[name]) if name in defaults else F.col(name)

    return newest.select("institution_id", *[
        F.struct(*[value(f"{g}__{f}").alias(f) for f in names]).alias(g)
        for g, names in groups.items()])
