"""Connected components of a stored edge list, each labelled by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm.common import written

FEW_EDGES = 100_000  # counted edges (16 bytes each) that one task may hold


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest node that u meets, itself included; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
                                           for x, y in ("ab", "ba")])))
    return both.join(_smallest(both), "u").where("v > u").select(
        F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and its larger neighbour, to the smallest node that it meets."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # v < u
    return down.join(_smallest(down), "u").select(F.inline(F.array(*[
        F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("v", "u")]))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` holds long columns a > b.

    Alternates large and small stars until nothing changes, which takes a logarithmic number of
    rounds; edges, never whole components, are dealt out, and each round is stored. Edges that were
    counted to be few stay in one task, where the joins need no exchange.
    """
    held, seen = written(edges.select("a", "b").distinct()), None
    while True:
        mark = held.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
        if mark[0] <= FEW_EDGES:
            held = held.coalesce(1)
        held = written(_small_star(_large_star(held).distinct()).distinct())
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
