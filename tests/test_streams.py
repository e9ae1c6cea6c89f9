"""Streams give the batch folds' answers, and repeating their input changes nothing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumbung.operators import runlog
from lumbung.sources.packages import stream_pages
from lumbung.streaming import folds, ingest, live, store

REQUIRED = ["id", "kind"]


def page(run, start, rows, total, length=2):
    return {"run_id": run, "page_start": start, "requested_length": length, "page_draw": start,
            "payload": json.dumps({"data": rows, "recordsFiltered": total})}


PAGES = [
    page("r", 0, [{"id": 1, "kind": "a"}, {"id": 2}], 4),
    page("r", 2, [{"id": 3, "kind": "a"}, {"id": 3, "kind": "b"}], 4),
    page("r", 0, [{"id": 9, "kind": "a"}], 4),
]


def test_pages_are_stored_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n, check in enumerate(("c1", "c2")):  # a second stream sees the same pages again
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, PAGES)))
        ingest.ingest_pages(stream_pages(spark, source), target, str(tmp_path / check),
                            REQUIRED).awaitTermination()
    kept = spark.read.parquet(f"{target}/canonical")
    assert [r.id for r in kept.collect()] == [1]
    assert spark.read.parquet(f"{target}/quarantine").count() == 3
    provenance = spark.read.parquet(f"{target}/provenance")
    times = {r.captured_at for r in provenance.collect()}
    assert len(times) == 1 and next(iter(times)).endswith("Z")
    assert ingest.capture_time(spark, target, str(tmp_path / "c1"), 0) == next(iter(times))
    assert sorted(r.source_offset for r in provenance.collect()) == [0, 1, 2, 3]
    failures = spark.read.parquet(f"{target}/failures").collect()
    assert [f.validation_error for f in failures] == ["expected 2 rows but source returned 1"]


EVENT = "institution_id string, seq bigint, type string, mismatch_id string, " \
        "replacement_id string, rejected_fingerprint string, parent_mismatch_id string, " \
        "email string, evidence_url string, fingerprint string"
EVENTS = [
    ("a", -1, "CANONICAL", None, None, None, None, "c", "u", "f0"),
    ("a", 1, "MISMATCH", "m1", None, "f0", None, None, None, None),
    ("a", 2, "REPLACEMENT", None, "r1", None, "m1", "e1", "u1", "f1"),
    ("a", 3, "MISMATCH", "m2", None, "f1", None, None, None, None),
    ("a", 4, "REPLACEMENT", None, "r2", None, "m1", "no", "u2", "f9"),
    ("a", 5, "REPLACEMENT", None, "r3", None, "m2", "e3", "u3", "f3"),
    ("b", -1, "CANONICAL", None, None, None, None, "c", "u", "f0"),
    ("b", 6, "MISMATCH", "m3", None, "f0", None, None, None, None),
    ("c", 7, "REPLACEMENT", None, "r4", None, "m9", "x", "u", "f"),
]


def feed(spark, tmp_path, name, rows, schema):
    """A stream of two rows per batch, in a shuffled order of arrival."""
    path = str(tmp_path / name)
    for row in random.Random(3).sample(rows, len(rows)):
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def test_effective_contact_stream_and_batch(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, EVENT)
    start = events.where("type = 'CANONICAL'").select(
        "institution_id", "email", F.col("evidence_url").alias("source_url"), "fingerprint")
    batch = folds.effective_contact(events.where("type <> 'CANONICAL'"), start, block=2)
    want = {("a", "e3", "REPLACEMENT")}
    assert {(r.institution_id, r.email, r.kind) for r in batch.collect()} == want
    out = str(tmp_path / "out")
    for check in ("c1", "c2"):  # a second stream sees the same events again
        live.stream_effective_contacts(feed(spark, tmp_path, "ev", EVENTS, EVENT), out, str(
            tmp_path / check)).awaitTermination()
        got = live.current_state(spark, out).where("email is not null").collect()
        assert {(r.institution_id, r.email, r.kind) for r in got} == want
    assert spark.read.parquet(f"{out}/log").count() == len(EVENTS)


def test_late_event_counts(spark, tmp_path):
    out = str(tmp_path / "out")
    for i, part in enumerate(([EVENTS[0], EVENTS[2]], [EVENTS[1]])):
        live.fold_batch(spark.createDataFrame(part, EVENT), out, f"{out}/state/stream=s/batch_id={i}",
                        live.contact_fold)
    got = live.current_state(spark, out).first()
    assert (got.email, got.kind) == ("e1", "REPLACEMENT")


DRAFT = "institution_id string, seq bigint, status string, text string, review_status string, " \
        "sent boolean, actor string, ts string"
DRAFTS = [
    ("a", 1, None, "hello", None, None, "x", "t1"),
    ("a", 2, "READY_TO_SEND", None, None, None, "x", "t2"),
    ("a", 3, "APPROVED", None, None, None, "x", "t3"),
    ("a", 4, "READY_TO_SEND", None, None, None, "x", "t4"),
    ("a", 5, "SENT", None, None, None, "x", "t5"),
    ("b", 1, "APPROVED", None, None, None, "x", "t1"),
    ("b", 2, "APPROVED", "text", None, None, "x", "t2"),
    ("b", 3, None, "new text", None, None, "x", "t3"),
    ("b", 4, "READY_TO_SEND", None, None, None, "x", "t4"),
]


def test_draft_stream_and_batch(spark, tmp_path):
    commands = spark.createDataFrame(DRAFTS, DRAFT)
    history = {(r.institution_id, r.seq): r.rejection
               for r in folds.draft_history(commands, block=2).collect()}
    assert history["a", 2] == "APPROVAL_REQUIRED" and history["a", 4] is None
    assert history["a", 5] == "FINAL_STATE_SERVER_ONLY"
    assert history["b", 1] == "DRAFT_REQUIRED" and history["b", 4] == "APPROVAL_REQUIRED"
    want = {("a", "hello", "READY_TO_SEND", True, True, 1),
            ("b", "new text", "EDITED", False, False, 2)}
    fields = ("institution_id", "text", "status", "approved", "ready_to_send", "version")
    state = folds.draft_state(commands, block=2).collect()
    assert {tuple(r[f] for f in fields) for r in state} == want
    out = str(tmp_path / "out")
    live.stream_drafts(feed(spark, tmp_path, "dr", DRAFTS, DRAFT), out, str(
        tmp_path / "check")).awaitTermination()
    assert {tuple(r[f] for f in fields) for r in live.current_state(spark, out).collect()} == want


def test_nothing_is_ready_without_an_approver(spark, tmp_path):
    rows = [("a", 1, "APPROVED", "text", None, None, None, "t1"),
            ("a", 2, "READY_TO_SEND", None, None, None, "x", "t2")]
    out = str(tmp_path / "out")
    live.fold_batch(spark.createDataFrame(rows, DRAFT), out, f"{out}/state/stream=s/batch_id=0",
                    folds.draft_state)
    got = live.current_state(spark, out).first()
    assert (got.status, got.ready_to_send) == ("APPROVED", False)


def test_commands_across_batches(spark, tmp_path):
    path = str(tmp_path / "commands")
    schema = "command_id string, canonical_content string, seq bigint"
    first = live.append_commands(spark.createDataFrame([("c", "x", 1), ("d", "y", 2)], schema),
                                 path)
    assert {r.verdict for r in first.collect()} == {"created"}
    again = live.append_commands(spark.createDataFrame([("c", "x", 3), ("c", "z", 4)], schema),
                                 path)
    assert {(r.seq, r.verdict) for r in again.collect()} == {(3, "replayed"), (4, "conflict")}
    for _ in range(2):  # the first batch again, and a late command with a lower number
        late = live.append_commands(spark.createDataFrame(
            [("c", "x", 1), ("d", "y", 2), ("c", "other", 0)], schema), path)
        assert {(r.command_id, r.seq, r.verdict) for r in late.collect()} == {
            ("c", 1, "replayed"), ("d", 2, "replayed"), ("c", 0, "conflict")}
        assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("row,error", [
    ({"id": 1}, "row 0 is missing fields: kind"),
    ({"kind": "a", "id": None}, "row 0 has a null id"),
    ([1], "row 0 is not an object"),
    ({"id": None}, "row 0 is missing fields: kind; row 0 has a null id"),
])
def test_row_errors(spark, row, error):
    df = spark.createDataFrame([page("r", 0, [row], 1, 1)])
    rows = runlog.classify_rows(runlog.page_rows(runlog.parse_pages(df)), REQUIRED)
    assert rows.first().validation_error == error


def test_ids_of_different_types_are_not_duplicates(spark):
    rows = [{"id": 1, "kind": "a"}, {"id": "1", "kind": "a"}]
    df = spark.createDataFrame([page("r", 0, rows, 2)])
    out = runlog.classify_rows(runlog.page_rows(runlog.parse_pages(df)), REQUIRED).collect()
    assert all(r.is_valid for r in out)


@pytest.mark.parametrize("payload,error", [
    ("[1]", "response payload is not an object"),
    ('{"data": 1, "recordsFiltered": 1}', "response field 'data' is not an array"),
    ('{"data": [], "recordsFiltered": "x"}',
     "response field 'recordsFiltered' is not an integer"),
    ('{"data": [], "recordsFiltered": 5}', "expected 2 rows but source returned 0"),
    ("not json", "response payload is not an object"),
])
def test_page_errors(spark, payload, error):
    df = spark.createDataFrame([{**page("r", 0, [], 0), "payload": payload}])
    assert runlog.parse_pages(df).first().page_error == error


def test_short_histories_are_walked_and_long_ones_doubled(spark):
    rng = random.Random(12)
    rows = []
    for i in range(12):
        for seq in range(3 + 9 * (i % 4)):
            rejects = rng.random() < 0.5
            rows.append((f"i{i}", seq, "MISMATCH" if rejects else "REPLACEMENT",
                         f"m{rng.randrange(2)}", f"r{seq}", f"fp{rng.randrange(2)}",
                         f"m{rng.randrange(2)}", f"{seq}@x", "u", f"fp{rng.randrange(2)}"))
    events = spark.createDataFrame(rows, "institution_id string, seq long, type string, "
                                   "mismatch_id string, replacement_id string, "
                                   "rejected_fingerprint string, parent_mismatch_id string, "
                                   "email string, evidence_url string, fingerprint string")
    start = spark.createDataFrame([(f"i{i}", "c@x", "u", None if i == 5 else "fp0")
                                   for i in range(12)], "institution_id string, email string, "
                                  "source_url string, fingerprint string")
    want = {}
    for i in range(12):
        held = None if i == 5 else ("F", "fp0", "c@x")
        for r in sorted(x for x in rows if x[0] == f"i{i}"):
            if r[2] == "MISMATCH" and held and held[:2] == ("F", r[5]):
                held = ("M", r[3], None)
            elif r[2] == "REPLACEMENT" and held and held[:2] == ("M", r[6]):
                held = ("F", r[9], r[7])
        if held and held[0] == "F":
            want[f"i{i}"] = held[2]
    assert len(set(want.values())) > 2
    for folded in (0, 13, 1000):
        got = folds.effective_contact(events, start, block=4, folded=folded).collect()
        assert {r.institution_id: r.email for r in got} == want


def test_short_draft_histories_are_dealt_once(spark):
    commands = spark.range(60).selectExpr(
        "concat('i', id % 5) as institution_id", "id as seq",
        "case id % 7 when 0 then 'APPROVED' when 3 then 'READY_TO_SEND' end as status",
        "case when id % 3 = 0 then concat('t', id % 4) end as text",
        "cast(null as string) as review_status", "id % 11 = 0 as sent", "'a' as actor",
        "cast(id as string) as ts")
    short = folds.draft_history(commands, block=12)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(str, short.collect())) == sorted(
        map(str, folds.draft_history(commands, block=5).collect()))


def test_a_folder_is_written_by_few_tasks(spark, tmp_path):
    rows = spark.range(4000).repartition(40).selectExpr("id", "cast(id % 3 as int) as bucket")
    store.append_new(rows, f"{tmp_path}/log", ["id"], "bucket")
    files = list((tmp_path / "log").glob("bucket=*/*.parquet"))
    assert len(files) <= 3 * store.WRITERS and spark.read.parquet(
        f"{tmp_path}/log").count() == 4000


def test_rows_of_a_page_are_classified_without_a_join(spark):
    pages = spark.createDataFrame(PAGES).repartition("run_id", "page_start", "page_draw")
    rows = runlog.classify_rows(runlog.page_rows(runlog.parse_pages(pages)), REQUIRED)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted((r.source_offset, r.is_valid) for r in rows.collect()) == [
        (0, True), (1, False), (2, False), (3, False)]


def test_stored_rows_are_not_made_again(spark, tmp_path):
    once = F.when(F.col("id") < 3, F.raise_error(F.lit("made again")).cast("long")).otherwise(
        F.col("id")).alias("made")
    rows = spark.range(3).selectExpr("id", "nullif(id, 1) as part", "0 as bucket")
    store.append_new(rows, f"{tmp_path}/log", ["id", "part"], "bucket", lambda r: r.select(
        "*", F.col("id").alias("made")))
    more = spark.range(5).selectExpr("id", "nullif(id, 1) as part", "0 as bucket")
    store.append_new(more, f"{tmp_path}/log", ["id", "part"], "bucket", lambda r: r.select(
        "*", once))
    assert sorted(r.made for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [
        0, 1, 2, 3, 4]
