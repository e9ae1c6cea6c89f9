"""Delimited files cut into byte ranges, with quoted line breaks and true row numbers.

A reader that allows line breaks inside quotes takes a whole file in one task, because only the
number of quotes before a place tells whether a line break there ends a record. Here Spark cuts
files into ranges of lines as usual. Each range first tells whether its number of quotes is odd, and
how many records end in it for either state at its beginning. A running XOR and a running sum over
these few rows give every range its state and the number of its first record; then each range is
read alone. Only records that cross a border are put together by a shuffle.

Defined results: blank lines between records do not count; a quote that is never closed makes the
rest of its file one record; a trailing carriage return and a byte-order mark are removed; an empty
file has no records.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMMARY = "path string, start long, odd int, ends_even long, ends_odd long"
PIECES = "path string, record long, start long, whole boolean, text string"


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(
        paths).select(F.col("_metadata.file_path").alias("path"),
                      F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, slice]]:
    """Consecutive lines of one range."""
    paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
    a = 0
    for b in range(1, len(paths) + 1):
        if b == len(paths) or starts[b] != starts[a] or paths[b] != paths[a]:
            yield paths[a], starts[a], slice(a, b)
            a = b


def _states(values: pa.Array, odd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quote states before and after each line, and which lines are blank."""
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    after = (np.cumsum(quotes) + odd) & 1
    before = np.concatenate([[odd], after[:-1]])
    blank = pc.equal(pc.utf8_trim(values, "\r"), "").to_numpy(zero_copy_only=False)
    return before, after, blank


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[int]] = {}  # ranges of this task
    for batch in batches:
        for path, start, run in _runs(batch):
            own = held.setdefault((path, start), [0, 0, 0])
            before, after, blank = _states(batch.column("value")[run], own[0])
            for state in (0, 1):  # own[0] is the state when the range begins outside quotes
                own[1 + state] += int(((after == state) & ~(blank & (before == state))).sum())
            own[0] = int(after[-1])
    keys = list(held)
    yield pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
        pa.array([held[k][0] for k in keys], pa.int32()),
        *[pa.array([held[k][i] for k in keys], pa.int64()) for i in (1, 2)]],
        ["path", "start", "odd", "ends_even", "ends_odd"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of each range."""
    at, odd, record, crossing, held = None, 0, 0, False, []
    for batch in batches:
        out: list[tuple] = []
        for path, start, run in _runs(batch):
            if (path, start) != at:
                if held:
                    out.append((*at, record, False, "\n".join(held)))
                odd, record = (batch.column(x)[run.start].as_py() for x in ("entry", "first"))
                at, crossing, held = (path, start), odd == 1, []
            values = batch.column("value")[run]
            before, after, blank = _states(values, odd)
            for text, b, a, empty in zip(values.to_pylist(), before.tolist(), after.tolist(),
                                         blank.tolist(), strict=True):
                if empty and not b:
                    continue
                held.append(text)
                if not a:
                    out.append((path, start, record, not crossing, "\n".join(held)))
                    record, crossing, held = record + 1, False, []
            odd = int(after[-1])
        yield _piece_batch(out)
    if held:
        yield _piece_batch([(*at, record, False, "\n".join(held))])


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": (0, pa.string()), "record": (2, pa.int64()), "start": (1, pa.int64()),
             "whole": (3, pa.bool_()), "text": (4, pa.string())}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in kinds.values()], list(kinds))


def records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, record, text) of every record; record 0 of a file is its header."""
    lines = _lines(spark, paths)
    order = Window.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = lines.mapInArrow(_summaries, SUMMARY).withColumn("entry", F.pmod(F.coalesce(
        F.sum("odd").over(earlier), F.lit(0)), F.lit(2)).cast("int"))
    ended = F.when(F.col("entry") == 0, F.col("ends_even")).otherwise(F.col("ends_odd"))
    ranges = summary.withColumn("ended", ended).select("path", "start", "entry", F.coalesce(
        F.sum("ended").over(earlier), F.lit(0)).alias("first"))
    # One row per range of a file: some millions even for a folder of hundreds of terabytes.
    pieces = lines.join(F.broadcast(ranges), ["path", "start"]).select(
        "path", "start", "value", "entry", "first").mapInArrow(_pieces, PIECES)
    whole = pieces.where("whole").select("path", "record", "text")
    crossing = pieces.where("not whole").groupBy("path", "record").agg(F.array_sort(
        F.collect_list(F.struct("start", "text"))).alias("parts")).select(
        "path", "record", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias(
            "text"))
    return whole.unionByName(crossing).withColumn("text", F.regexp_replace(
        "text", "^﻿|\r$", ""))


def field_count(text: Column) -> Column:
    """Fields of a record, from the commas outside quotes."""
    return F.size(F.split(F.regexp_replace(text, '"[^"]*"', ""), ",", -1))


def closed(text: Column) -> Column:
    """Whether every quote of a record is closed."""
    return F.pmod(F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit(""))), F.lit(2)) == 0


def header_names(header: str) -> list[str]:
    """Column names of a header record; empty and repeated names are told apart by position."""
    seen: set[str] = set()
    out = []
    for i, name in enumerate(next(csv.reader([header.replace("\n", " ")]), [])):
        unique = name if name and name.lower() not in seen else f"{name}_{i}"
        seen.add(unique.lower())
        out.append(unique)
    return out


def parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (path, record, text) of one header as columns; missing fields are null."""
    schema = ", ".join(f"`_c{i}` string" for i in range(len(names)))
    cells = rows.select("path", "record", F.from_csv("text", schema, {
        "escape": '"', "maxCharsPerColumn": "-1"}).alias("cells"))
    return cells.select(F.col("path").alias("_path"), F.col("record").alias("_record"), *[
        F.col(f"cells._c{i}").alias(n) for i, n in enumerate(names)])
