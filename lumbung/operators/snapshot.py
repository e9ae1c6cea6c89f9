"""Snapshot metrics, differences, page integrity, replay state and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbung.functions.digests import row_digest
from lumbung.functions.ranking import one_per_group
from lumbung.functions.text import normalize, squeeze
from lumbung.operators.scan import previous


# ---- metrics and checks ----------------------------------------------------------------------
def metrics(df: DataFrame, id_column: str) -> DataFrame:
    """Row, distinct-id and null-id counts and id bounds."""
    key = F.col(id_column)
    return df.agg(
        F.count("*").alias("row_count"), F.count_distinct(key).alias("distinct_id_count"),
        F.count_if(key.isNull()).alias("null_id_count"), F.min(key).alias("min_id"),
        F.max(key).alias("max_id"))


def same_schema(df: DataFrame, expected: T.StructType) -> bool:
    """Names and types in order; readers report every column nullable, so that is not compared."""
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in expected]


def checks(df: DataFrame, id_column: str, expected: T.StructType) -> DataFrame:
    """One row per named check with PASS / FAIL."""
    m = metrics(df, id_column)
    named = {
        "schema": F.lit(same_schema(df, expected)),
        "row_count": F.col("row_count") > 0,
        "unique_ids": F.col("distinct_id_count") == F.col("row_count"),
        "null_ids": F.col("null_id_count") == 0,
    }
    return verdict_rows(m, named)


def verdict_rows(one_row: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(position, gate, verdict) rows of named conditions; unknown counts as failed."""
    items = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("gate"),
                 F.when(F.coalesce(cond, F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"))
        for i, (name, cond) in enumerate(named.items())])
    return one_row.select(F.explode(items).alias("g")).select("g.*")


# ---- difference of two snapshots -------------------------------------------------------------
def diff(baseline: DataFrame, candidate: DataFrame, id_column: str) -> DataFrame:
    """Every id of either side with added / missing / changed / unchanged / duplicate.

    Only (id, digest) is shuffled; grouping and join share the partitioning by id.
    """
    if not same_schema(candidate, baseline.schema):
        raise ValueError("snapshot schema mismatch")
    content = [c for c in baseline.columns if c != id_column]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(id_column), row_digest(df, content).alias("d")).groupBy(
            id_column).agg(F.count("*").alias(f"{name}_n"), F.max("d").alias(f"{name}_d"))

    both = side(baseline, "b").join(side(candidate, "c"), id_column, "full_outer")
    change = (
        F.when((F.col("b_n") > 1) | (F.col("c_n") > 1), "duplicate")
        .when(F.col("b_n").isNull(), "added").when(F.col("c_n").isNull(), "missing")
        .when(F.col("b_d") != F.col("c_d"), "changed").otherwise("unchanged"))
    return both.select(id_column, change.alias("change"), F.col("b_n").alias("baseline_rows"),
                       F.col("c_n").alias("candidate_rows"))


def diff_summary(changes: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count_if(F.col("change") == kind)

    return changes.agg(
        F.coalesce(F.sum("baseline_rows"), F.lit(0)).alias("baseline_row_count"),
        F.coalesce(F.sum("candidate_rows"), F.lit(0)).alias("candidate_row_count"),
        (F.coalesce(F.sum("candidate_rows"), F.lit(0))
         - F.coalesce(F.sum("baseline_rows"), F.lit(0))).alias("row_count_difference"),
        n("added").alias("ids_added_count"), n("missing").alias("ids_missing_count"),
        n("changed").alias("ids_changed_count"),
        (n("changed") + n("unchanged")).alias("shared_id_count"),
        n("duplicate").alias("duplicate_id_count"))


# ---- pagination ------------------------------------------------------------------------------
def page_bounds(rows: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Per page: size, first and last id, order faults inside and across the page boundary.

    ``rows`` has page (long), position, id and source_count; a page is small by construction.
    """
    within = Window.partitionBy("page").orderBy("position")
    stepped = rows.withColumn("_before", F.lag("id").over(within))
    pages = stepped.groupBy("page").agg(
        F.count("*").alias("rows_received"), F.min_by("id", "position").alias("first_id"),
        F.max_by("id", "position").alias("last_id"),
        F.count_if(F.col("_before") <= F.col("id")).alias("order_faults"),
        F.max("source_count").alias("source_count"),
        F.min("source_count").alias("_min_source"))
    linked = previous(pages, [], "page", ["page", "last_id"], block=block)
    boundary = (F.col("previous.page") == F.col("page") - 1) & (
        F.col("previous.last_id") <= F.col("first_id"))
    return linked.withColumn("boundary_fault", F.coalesce(boundary, F.lit(False))).drop("previous")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("occurrences"),
                                  F.count_distinct("page").alias("pages")).where(
        "occurrences > 1")


def page_overlaps(rows: DataFrame) -> DataFrame:
    """(id, page) of every id seen on several pages: linear in the rows, never pairs of pages."""
    repeated = duplicate_ids(rows).where("pages > 1").select("id", "pages")
    return rows.select("id", "page").distinct().join(repeated, "id")


def pagination_summary(rows: DataFrame, page_size: int) -> DataFrame:
    pages = page_bounds(rows)
    dup = duplicate_ids(rows).agg(F.count("*").alias("duplicate_ids"),
                                  F.count_if(F.col("pages") > 1).alias("overlapping_ids"))
    facts = pages.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("rows_received") != page_size).alias("page_size_failures"),
        F.count_if(F.col("order_faults") > 0).alias("pages_out_of_order"),
        F.count_if("boundary_fault").alias("boundary_faults"),
        (F.min("_min_source") == F.max("source_count")).alias("source_count_consistent"))
    repeats = dup.select(F.struct("*")).scalar()
    out = facts.withColumns({c: repeats[c] for c in dup.columns})
    return out.withColumn("passed", (F.col("page_size_failures") == 0)
                          & (F.col("pages_out_of_order") == 0) & (F.col("boundary_faults") == 0)
                          & (F.col("duplicate_ids") == 0) & F.col("source_count_consistent"))


def offset_gaps(rows: DataFrame, keys: list[str], offset: str,
                block: int = 1_000_000) -> DataFrame:
    """Offsets not following their predecessor; the first one must be 0."""
    stepped = previous(rows.select(*keys, offset), keys, offset, [offset], block=block)
    expected = F.coalesce(F.col(f"previous.{offset}") + 1, F.lit(0))
    return stepped.select(*keys, offset, expected.alias("expected")).where(
        F.col(offset) != F.col("expected"))


# ---- replay ----------------------------------------------------------------------------------
def replay_state(batch: DataFrame, stored: DataFrame, id_column: str,
                 batch_key: str) -> DataFrame:
    """Per batch: absent / partial / complete / conflict against the stored rows."""
    content = [c for c in stored.columns if c != id_column]
    right = stored.select(F.col(id_column), row_digest(stored, content).alias("_stored"))
    left = batch.select(batch_key, id_column, row_digest(batch, content).alias("_batch"))
    joined = left.join(right, id_column, "left")
    counts = joined.groupBy(batch_key).agg(
        F.count("*").alias("expected_count"), F.count("_stored").alias("observed_count"),
        F.count_if(F.col("_stored") == F.col("_batch")).alias("equal_count"))
    state = (F.when(F.col("observed_count") == 0, "absent")
             .when(F.col("observed_count") < F.col("expected_count"), "partial")
             .when(F.col("equal_count") == F.col("expected_count"), "complete")
             .otherwise("conflict"))
    return counts.select(batch_key, "expected_count", "observed_count", state.alias("state"))


def rows_to_append(batch: DataFrame, stored: DataFrame, id_column: str,
                   batch_key: str) -> DataFrame:
    """Rows of the batches that are wholly absent: appending twice adds nothing."""
    absent = replay_state(batch, stored, id_column, batch_key).where("state = 'absent'")
    return batch.join(absent.select(batch_key), batch_key, "left_semi")


# ---- deduplication and upsert ----------------------------------------------------------------
def dedup_union_keywords(rows: DataFrame, position: str) -> DataFrame:
    """One row per (normalised code, source type): the first row, keywords of all of them."""
    keyed = rows.withColumn("_code", normalize(F.col("package_code")))
    first = one_per_group(keyed.drop("keyword", "matched_keywords"), ["_code", "source_type"],
                          F.col(position))
    words = keyed.select("_code", "source_type", F.explode(F.array_union(
        F.array("keyword"), F.split("matched_keywords", ";"))).alias("word")).where(
        "word <> ''").distinct().groupBy("_code", "source_type").agg(
        F.array_join(F.array_sort(F.collect_set("word")), ";").alias("matched_keywords"))
    return first.join(words, ["_code", "source_type"], "left").drop("_code")


def package_identity(code: Column, *fields: Column) -> Column:
    """Identity of an evidence row: its code, else its five descriptive fields."""
    clean_code = squeeze(code)
    return F.when(clean_code != "", F.struct(F.lit("code").alias("by"), clean_code.alias("value"))
                  ).otherwise(F.struct(F.lit("row").alias("by"), F.concat_ws(
                      "\u001f", *[squeeze(f) for f in fields]).alias("value")))


def dedup_packages(rows: DataFrame, position: str) -> DataFrame:
    keyed = rows.withColumn("_identity", package_identity(*[F.col(c) for c in (
        "package_code", "package_name", "institution_name", "stage_or_status", "hps_or_pagu",
        "method")]))
    return one_per_group(keyed, ["_identity"], F.col(position)).drop("_identity")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """Existing rows overlaid by incoming ones; the last incoming row of a key wins."""
    latest = one_per_group(incoming, [key], F.col(position), largest=True).drop(position)
    kept = existing.join(latest, key, "left_anti")
    return kept.unionByName(latest)


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Inserted / updated as the rows arrive: a repeat of a new key counts as an update."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    arrivals = incoming.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")
    is_new = F.col("_known").isNull()
    added = F.count_if(is_new)
    counts = arrivals.agg(
        added.alias("inserted"),
        (F.coalesce(F.sum("n"), F.lit(0)) - added).alias("updated"))
    before = existing.agg(F.count_distinct(key)).scalar()
    return counts.withColumn("total", F.col("inserted") + before)
