"""Event logs folded as streams.

A micro-batch's events are added to a stored log, each once, and the batch folds of ``folds.py``
run again over the stored history of the institutions in the batch. Late, shuffled and repeated
events therefore end in the state that the batch fold gives, and the rules are stated only there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumbung.session import cut_lineage
from lumbung.streaming import folds
from lumbung.streaming.store import BUCKET, append_new, bucket, in_partitions, stored

KEY = "institution_id"
Fold = Callable[[DataFrame], DataFrame]


def contact_fold(history: DataFrame) -> DataFrame:
    """Contact in force; canonical contacts are events of type CANONICAL with seq -1."""
    start = history.where("type = 'CANONICAL'").select(
        KEY, "email", F.col("evidence_url").alias("source_url"), "fingerprint")
    return folds.effective_contact(history.where("type <> 'CANONICAL'"), start)


def fold_batch(batch: DataFrame, target: str, state_path: str, fold: Fold) -> None:
    """Stores a batch's events and the new state of its institutions; may be run again."""
    spark = batch.sparkSession
    events = batch.dropDuplicates([KEY, "seq"]).withColumn(BUCKET, bucket(KEY)).persist()
    try:
        append_new(events, f"{target}/log", [KEY, "seq"], BUCKET)
        keys = events.select(KEY).distinct()
        history = in_partitions(stored(spark, f"{target}/log"), BUCKET, events).join(
            keys, KEY, "left_semi").drop(BUCKET)
        # The log only grows, so of two states of a key the one of more events is the newer.
        folded = history.groupBy(KEY).agg(F.count("*").alias("events_folded"))
        folded.join(fold(history), KEY, "left").write.mode("overwrite").parquet(state_path)
    finally:
        events.unpersist()


def _fold_stream(events: DataFrame, target: str, checkpoint: str, fold: Fold) -> StreamingQuery:
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def handle(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, target, f"{target}/state/stream={name}/batch_id={batch_id}", fold)

    return events.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_effective_contacts(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Contact in force after each batch; see ``contact_fold``."""
    return _fold_stream(events, target, checkpoint, contact_fold)


def stream_drafts(commands: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Draft state after each batch of commands."""
    return _fold_stream(commands, target, checkpoint, folds.draft_state)


def current_state(spark: SparkSession, target: str) -> DataFrame:
    """Newest state of every institution that a stream has met."""
    rows = spark.read.parquet(f"{target}/state")
    fields = [c for c in rows.columns if c not in (KEY, "stream", "batch_id", "events_folded")]
    return rows.groupBy(KEY).agg(F.max_by(F.struct(*fields), "events_folded").alias("s")).select(
        KEY, "s.*")


def append_commands(batch: DataFrame, path: str) -> DataFrame:
    """Verdict of every command in a batch; stores the first command of each new id.

    A stored id can only be replayed or in conflict, so running a batch again stores nothing.
    """
    columns = ["command_id", "canonical_content", "seq"]
    rows = batch.select(*columns).withColumn(BUCKET, bucket("command_id"))
    held = stored(batch.sparkSession, path)
    if held is None:
        known = rows.select("command_id", F.col("canonical_content").alias("_first")).limit(0)
    else:
        known = in_partitions(held, BUCKET, rows).groupBy("command_id").agg(
            F.min_by("canonical_content", "seq").alias("_first"))
    old = rows.join(known, "command_id").withColumn("verdict", F.when(
        F.col("canonical_content").eqNullSafe(F.col("_first")), "replayed").otherwise("conflict"))
    new = folds.idempotent_commands(rows.join(known, "command_id", "left_anti"))
    # Judged before the write below changes what is stored.
    judged = cut_lineage(old.select(*columns, BUCKET, "verdict").unionByName(
        new.select(*columns, BUCKET, "verdict")))
    judged.where("verdict = 'created'").select(*columns, BUCKET).write.mode("append").partitionBy(
        BUCKET).parquet(path)
    return judged.drop(BUCKET)


def stream_commands(commands: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Commands judged batch by batch; a batch that runs again keeps its first verdicts."""
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def handle(batch: DataFrame, batch_id: int) -> None:
        path = f"{target}/verdicts/stream={name}/batch_id={batch_id}"
        if stored(batch.sparkSession, path) is None:
            append_commands(batch, f"{target}/commands").write.mode("overwrite").parquet(path)

    return commands.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
