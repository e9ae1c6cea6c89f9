"""Which rows each filter of a chain removes, in every order of the filters.

Each filter has a stored id table of the rows that fail it. From these tables alone all prefixes
of all orders are worked out: what a filter removes after a prefix are its failing ids that are in
none of the prefix's tables (left-anti joins), what it finds removed already are those that are in
one (left-semi joins), and a prefix's survivors are the ids of all failing rows under the same
anti joins, plus the rows that fail nothing. A prefix counts only as a set, and a set is reached by
adding its filters in one fixed order, so each level of joins takes the stored rows of the level
before. An order's steps then look their prefix up.

Rows are told apart by a number given when they are stored, so repeated rows and null ids count
row by row. The row number is the only join key, which no frequent value can make uneven; counts
are combined before they are shuffled.

Defined results: null text is empty; a null source belongs to the part ``''``; a row without doc_id
never fails the copy filter, makes no other row fail it and has no labels; equal rows of one doc_id
are not copies of each other, as none has a smaller id; several labels of one doc_id count when any
of them is 1; an empty table gives no rows. Other columns are not read. Texts are taken as
identical when their SHA-256 digests are.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.llm.common import kept, pick, small

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65  # per cent of words
MAX_CAPITALS = 5  # per cent of code points
MARKS = "[#$%&*|]"


def failing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            source: str = "source") -> DataFrame:
    """(row, part, good, toxic, A, B, C, D, E) of every row, stored; a letter is true on failure."""
    whole = F.col("text")
    rows = pick(docs, doc_id=key, text=text, source=source).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce(whole, F.lit("")).alias("text"))
    split = rows.withColumn("words", F.split(F.btrim(whole, F.lit(SPACES)), SPACE))
    none = F.get("words", F.lit(0)) == ""  # only when the text has no word at all
    sized = split.withColumns({
        "n_words": F.when(none, 0).otherwise(F.size("words")),
        "n_distinct": F.when(none, 0).otherwise(F.size(F.array_distinct("words"))),
        "n_capitals": F.length(F.regexp_replace(whole, "[^A-Z]+", ""))})
    plain = kept(sized.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part",
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        (F.col("n_words") < MIN_WORDS).alias("A"),
        (F.col("n_distinct") * 100 < F.col("n_words") * MIN_DISTINCT).alias("B"),
        (F.col("n_capitals").cast("long") * 100 > F.length(whole).cast("long") * MAX_CAPITALS
         ).alias("C"), whole.rlike(MARKS).alias("D")))
    groups = small(kept(plain.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")))
    known = pick(labels, labelled="doc_id", quality="quality", toxic="toxic").where(
        "labelled is not null").groupBy(F.col("labelled").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = plain.join(groups, "digest", "left").join(
        small(kept(known)), F.col("doc_id") == F.col("labelled"), "left")
    return kept(marked.select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "A", "B", "C", "D",
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")))


def _ones(flag: str) -> Column:
    return F.count(F.when(F.col(flag), 1))


class Relations:
    """The id tables of the filters and the counts that their joins give for every prefix.

    A prefix is a bit mask of filter numbers. ``removed`` has (part, filter, mask, n, good, toxic):
    the filter's failing rows that pass the prefix; ``found`` (part, filter, mask, n): those that do
    not; ``alive`` (part, mask, n): failing rows that pass the prefix.
    """

    def __init__(self, marks: DataFrame, letters: str):
        ids = ["row", "part", "good", "toxic"]
        everything = len(letters)  # stands for the rows that fail any filter
        tables = [kept(marks.where(x).select(*ids)) for x in letters]
        fails = reduce(DataFrame.unionAll, [
            t.select(F.lit(i).alias("next"), "row") for i, t in enumerate(tables)])
        watched = reduce(DataFrame.unionAll, [
            t.select(F.lit(i).alias("filter"), *ids) for i, t in enumerate([
                *tables, marks.where(" or ".join(letters)).select(*ids)])])
        level = watched.select("filter", F.lit(0).alias("mask"), F.lit(-1).alias("last"), *ids)
        levels, lost = [level], []
        for _ in letters:
            steps = level.where(F.col("last") < len(letters) - 1).select("*", F.explode(F.sequence(
                F.col("last") + 1, F.lit(len(letters) - 1))).alias("next")).where("next <> filter")
            lost.append(steps.where(F.col("filter") < everything).join(
                fails, ["next", "row"], "left_semi").groupBy("part", "filter", "mask", "next").agg(
                F.count("*").alias("n")))
            level = kept(steps.join(fails, ["next", "row"], "left_anti").select(
                "filter", F.expr("mask | shiftleft(1, next)").alias("mask"),
                F.col("next").alias("last"), *ids))
            levels.append(level)
        counts = reduce(DataFrame.unionAll, [x.groupBy("part", "filter", "mask").agg(
            F.count("*").alias("n"), _ones("good").alias("good"), _ones("toxic").alias("toxic"))
            for x in levels])
        counts = kept(counts)
        self.removed = counts.where(F.col("filter") < everything)
        self.alive = counts.where(F.col("filter") == everything).select("part", "mask", "n")
        # Ids lost to ``next`` under a prefix stay lost under every larger prefix that ends alike.
        higher = F.explode(F.sequence(F.lit(0), F.expr(f"shiftright({(1 << everything) - 1}, "
                                                       "next + 1)")))
        self.found = kept(reduce(DataFrame.unionAll, lost)).select("*", higher.alias("above")).select(
            "part", "filter", "n", F.expr("mask | shiftleft(1, next) | shiftleft(above, next + 1)"
                                          ).alias("mask")).where(
            "mask & shiftleft(1, filter) = 0").groupBy("part", "filter", "mask").agg(
            F.sum("n").alias("found"))


def _orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, filter, mask) of every step of every order: a fixed small table."""
    rows = []
    for order in permutations(range(len(letters))):
        mask = 0
        for step, i in enumerate(order, 1):
            rows.append(("".join(letters[j] for j in order), step, i, mask))
            mask |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, mask int")


def interactions(marks: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, from stored rows (row, part, good, toxic, one flag each).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.
    """
    n = len(letters)
    held = Relations(marks, letters)
    parts = marks.groupBy("part").agg(F.count(F.when(~F.expr(" or ".join(letters)), 1)).alias(
        "clean"))
    cells = [F.struct(F.lit(f).alias("filter"), F.lit(mask).alias("mask"), F.lit(
        factorial(bin(mask).count("1")) * factorial(n - 1 - bin(mask).count("1"))).cast(
        "long").alias("orders")) for f in range(n) for mask in range(1 << n) if not mask >> f & 1]
    grid = parts.select("part", "clean", F.inline(F.array(*cells)))
    zero = F.lit(0).cast("long")
    with_counts = grid.withColumn("after", F.expr("mask | shiftleft(1, filter)")).join(
        held.removed, ["part", "filter", "mask"], "left").join(
        held.found, ["part", "filter", "mask"], "left").join(
        held.alive.select("part", F.col("mask").alias("after"), F.col("n").alias("alive")),
        ["part", "after"], "left")
    of_filter = Window.partitionBy("part", "filter")
    alone = F.expr(f"mask = {(1 << n) - 1} - shiftleft(1, filter)")
    done = with_counts.select(
        "part", "filter", "mask", (F.col("clean") + F.coalesce("alive", zero)).alias("kept"),
        F.coalesce("n", zero).alias("removed"), F.coalesce("found", zero).alias("redundant"),
        F.coalesce(F.max(F.when(alone, F.col("n"))).over(of_filter), zero).alias("unique_fails"),
        F.coalesce("good", zero).alias("good_lost"), F.coalesce("toxic", zero).alias("toxic_lost"),
        F.coalesce(F.sum(F.col("n") * F.col("orders")).over(of_filter), zero).alias("shapley"))
    return done.join(F.broadcast(_orders(marks.sparkSession, letters)), ["filter", "mask"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
