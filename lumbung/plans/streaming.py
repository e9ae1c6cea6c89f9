"""The streams run over the events table, in several batches, against the batch folds' SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.plans import acquisition, outreach_events
from lumbung.plans.registry import ORACLES, query
from lumbung.schemas import PAGES
from lumbung.session import checkpoint_root
from lumbung.streaming import ingest, live

BATCHES = 3


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def deliver(rows: DataFrame, folder: str, batch, run) -> None:
    """Gives a stream ``rows`` in batches, by the number that ``batch`` gives each row.

    A batch is written by all tasks. Each time one has arrived, the stream is started again from
    its checkpoint by ``run`` and takes it up as one micro-batch.
    """
    spark = rows.sparkSession
    rows.withColumn("_batch", batch).write.partitionBy("_batch").parquet(f"{folder}/sent")
    sent = spark.read.schema(rows.withColumn("_batch", F.lit(0)).schema).parquet(f"{folder}/sent")
    for i in range(BATCHES):
        sent.where(F.col("_batch") == i).drop("_batch").write.mode("append").parquet(
            f"{folder}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


def shuffled():
    """Events of one institution arrive in any order across batches."""
    return F.pmod(F.xxhash64("seq"), F.lit(BATCHES))


@query("stream_effective_contact", ORACLES["effective_contact"])
def stream_effective_contact(spark, sf_dir):
    folder = fresh_folder(spark, "contacts")
    moves = outreach_events.override_events(spark, sf_dir)
    start = outreach_events.canonical(spark, sf_dir).select(
        "institution_id", F.lit(-1).cast("long").alias("seq"), F.lit("CANONICAL").alias("type"),
        "email", F.col("source_url").alias("evidence_url"), "fingerprint")
    events = moves.unionByName(start, allowMissingColumns=True)
    deliver(events, folder, shuffled(), lambda stream: live.stream_effective_contacts(
        stream, f"{folder}/out", f"{folder}/check"))
    return live.current_state(spark, f"{folder}/out").where("kind is not null").select(
        "institution_id", "kind", "email")


@query("stream_draft_state", ORACLES["draft_state"])
def stream_draft_state(spark, sf_dir):
    folder = fresh_folder(spark, "drafts")
    commands = outreach_events.draft_commands(spark, sf_dir)
    deliver(commands, folder, shuffled(), lambda stream: live.stream_drafts(
        stream, f"{folder}/out", f"{folder}/check"))
    return live.current_state(spark, f"{folder}/out").select(
        "institution_id", "text", "approved", "version")


@query("stream_commands", ORACLES["idempotent_commands"])
def stream_commands(spark, sf_dir):
    """Batches in event order, so the first command of an id is the same as in the whole log."""
    folder = fresh_folder(spark, "commands")
    rows = outreach_events.command_rows(spark, sf_dir)
    most = rows.agg(F.max("seq")).scalar()
    deliver(rows, folder, F.floor(F.col("seq") * BATCHES / (most + 1)).cast("int"),
            lambda stream: live.stream_commands(stream, f"{folder}/out", f"{folder}/check"))
    return spark.read.parquet(f"{folder}/out/verdicts").select("seq", "verdict")


@query("stream_pages", acquisition._SPLIT + """
 SELECT event_id AS source_offset, CASE WHEN validation_error = '' THEN 'canonical'
  ELSE 'quarantine' END AS disposition, validation_error FROM v""")
def stream_pages(spark, sf_dir):
    """Every page is delivered twice, in different batches; its rows are stored once."""
    folder = fresh_folder(spark, "pages")
    pages = acquisition.source_pages(spark, sf_dir).select(*PAGES.fieldNames())
    twice = pages.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    batch = F.pmod(F.xxhash64("page_start") + F.col("_copy"), F.lit(BATCHES))
    placed = twice.withColumn("_at", batch).drop("_copy")
    deliver(placed, folder, F.col("_at"), lambda stream: ingest.ingest_pages(
        stream.drop("_at"), f"{folder}/out", f"{folder}/check", acquisition.REQUIRED))
    records = spark.read.parquet(f"{folder}/out/provenance").select("source_offset", "disposition")
    errors = spark.read.parquet(f"{folder}/out/quarantine").select(
        "source_offset", "validation_error")
    return records.join(errors, "source_offset", "left").select(
        "source_offset", "disposition", F.coalesce("validation_error", F.lit("")).alias(
            "validation_error"))
