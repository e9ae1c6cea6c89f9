"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.session import checkpoint_root, cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of the bounded membership filter: 2^18 words of 64 bits, about 4 MB when sent.
FILTER_WORDS = 1 << 18


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, found by exact spelling.

    Other columns, also ones whose names differ only in case, cannot clash with them.
    """
    places = {new: df.columns.index(old) for new, old in columns.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in places.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows under positional names, and the names to go back to."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def restored(df: DataFrame, names: list[str]) -> DataFrame:
    """Back to the original names; further columns are dropped."""
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def kept(df: DataFrame) -> DataFrame:
    """Written to the folder of spark.checkpoint.dir, so that later steps read the same rows."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """Like ``kept``, as a compressed Parquet table in that folder: far less disk than serialised
    rows, and later steps read only the columns they need."""
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


SMALL_ROWS = 50_000  # rows of a narrow table that may be sent to every task, after counting
BATCH_BYTES = 8 << 20  # text that one Arrow batch holds


def small(df: DataFrame) -> DataFrame:
    """``df``, sent to every task when it was counted to be small; joined by key otherwise.

    A stored table has no size estimate, so without this the other side's texts would move.
    """
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, so that two tasks fit into a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to; it is sized with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def likely(df: DataFrame, key: str, wanted: DataFrame, flag: str,
           words: int = FILTER_WORDS) -> DataFrame:
    """``df`` with a boolean that is true for every row whose long ``key`` is in ``wanted``.

    The keys set bits of a table of at most ``words`` 64-bit words; only that table is broadcast,
    so its size does not grow with the data. Bits are shared, so some other rows are true as
    well, and many when there are far more keys than bits: a prefilter before an exact step.
    """
    def place(name: str) -> tuple[Column, Column]:
        mixed = F.xxhash64(F.col(name))
        return F.pmod(mixed, F.lit(words)), F.pmod(F.shiftright(mixed, 40), F.lit(64)).cast("int")

    word, bit = place(wanted.columns[0])
    bits = wanted.select(word.alias("_word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(
        F.bit_or("_bit").alias("_bits"))
    word, bit = place(key)
    joined = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    found = F.getbit("_bits", bit) == 1
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_word", "_bits")
