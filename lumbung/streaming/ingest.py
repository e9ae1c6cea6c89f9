"""Page ingestion as a stream: canonical, quarantine and provenance tables, each row once."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumbung.operators import runlog
from lumbung.streaming.store import append_new, stored


def ingest_batch(pages: DataFrame, target: str, captured_at: Column,
                 required: list[str] | None = None) -> None:
    """Classify a batch of pages and store its rows; safe to run again for the same batch."""
    # The same page may arrive twice in one batch; its rows must not count as repeated ids. Whole
    # pages are dealt, so that their rows need no further shuffle for that count.
    page = ["run_id", "page_start", "page_draw"]
    parsed = runlog.parse_pages(pages.repartition(*page).dropDuplicates([*page, "payload"]))
    classified = runlog.classify_rows(runlog.page_rows(parsed), required).persist()
    try:
        append_new(classified.where("is_valid"), f"{target}/canonical",
                   ["run_id", "source_offset"], "run_id", runlog.storage_rows)
        append_new(runlog.quarantine_records(
            classified, captured_at, F.concat(F.lit("failures/page-start-"), F.col(
                "page_start").cast("string"))), f"{target}/quarantine",
            ["run_id", "quarantine_record_id"], "run_id")
        # A record's id is a digest of these two.
        append_new(classified, f"{target}/provenance", ["run_id", "source_offset"], "run_id",
                   lambda rows: runlog.provenance_records(rows, captured_at))
        append_new(runlog.page_failures(parsed), f"{target}/failures",
                   ["run_id", "start", "draw"], "run_id")
    finally:
        classified.unpersist()


def capture_time(spark: SparkSession, target: str, stream: str, batch_id: int) -> str:
    """When a batch was first taken up; a batch that runs again gets the same time."""
    path = f"{target}/batches"
    held = stored(spark, path)
    if held is not None:
        first = held.where((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).agg(
            F.min("captured_at")).first()[0]
        if first is not None:
            return first
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    spark.createDataFrame([(stream, batch_id, now)], "stream string, batch_id long, "
                          "captured_at string").write.mode("append").parquet(path)
    return now


def ingest_pages(pages: DataFrame, target: str, checkpoint: str,
                 required: list[str] | None = None) -> StreamingQuery:
    """Run the page stream until its input is used up."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        taken = capture_time(batch.sparkSession, target, checkpoint, batch_id)
        ingest_batch(batch, target, F.lit(taken), required)

    return pages.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
