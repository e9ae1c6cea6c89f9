"""Quality rules whose limits are learned per language and source, with built-in functions only.

Each document gets counts over its whole text. Shares made from them are summarised by one KLL
sketch per (language, source); sketches are merged upwards per language and over everything, so
that a group with few documents takes the limits of its language, or of the whole table. A limit
is the group's median plus a multiple of its lower spread, plus a slack; half of a group may be
junk before a limit moves. Documents are then filtered by a join with the limits.

Defined results: null text has no words and fails the base rule; null languages and sources form
groups of their own; repeated rows are judged one by one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.llm.common import UPPER, kept, numbered, pick, restored, small

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
SKETCH_K = 2048  # sketches of up to about as many values are exact
FEW = 30  # documents below which a group takes the limits of the next larger one
REACH = 6.0  # spreads beyond the median

# share: (slack above, slack below); None sets no limit on that side
SHARES: dict[str, tuple[float, float | None]] = {
    "word_length": (2.0, 2.0),
    "symbols": (0.1, None),
    "copied_lines": (0.35, None),
    "repeated": (0.3, None),
    "capitals": (0.3, None),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    def windows(hashes: Column) -> Column:
        starts = F.when(F.size(hashes) >= 3, F.sequence(F.lit(0), F.size(hashes) - 3)).otherwise(
            F.array().cast("array<int>"))
        return F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(
            F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias(
            "at"))))

    def repeated(ranked: Column) -> Column:
        """Places of windows that have an equal neighbour in hash order, ascending."""
        return F.array_sort(F.array_compact(F.transform(ranked, lambda s, i: F.when(
            (F.get(ranked, i - 1)["h"] == s["h"]) | (F.get(ranked, i + 1)["h"] == s["h"]),
            s["at"]))))

    def covered(places: Column) -> Column:
        """Each repeated window adds its three words, less those the one before has added."""
        return F.aggregate(
            places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")),
            lambda held, at: F.struct(
                (held["n"] + F.least(F.lit(3), at + 3 - held["end"])).cast("long").alias("n"),
                (at + 3).alias("end")), lambda held: held["n"])

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(
        windows(hashes), lambda ranked: covered(repeated(ranked))))


def measured(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and two more.

    The counts come out of one generator, so a later filter on them is not evaluated below it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def removed(characters: str) -> Column:
        return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counts = F.struct(
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).alias("n_symbols"), removed(UPPER).alias("n_capitals"),
        of_words.alias("of_words"), of_lines.alias("of_lines"))
    return df.select("*", F.inline(F.array(counts))).select(
        "*", "of_words.*", "of_lines.*").drop("of_words", "of_lines")


def shares(df: DataFrame) -> DataFrame:
    """The shares that limits are learned for, from the counts."""
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return df.withColumns({
        "word_length": ratio("word_chars", "n_words"), "symbols": ratio("n_symbols", "n_words"),
        "copied_lines": ratio("n_dup_lines", "n_lines"),
        "repeated": ratio("n_repeat_words", "n_words"),
        "capitals": ratio("n_capitals", "word_chars")})


def _limit(sketch: Column, slack: float, above: bool) -> Column:
    def at(rank: float) -> Column:
        return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))

    if above:
        return at(0.5) + (at(0.5) - at(0.25)) * REACH + slack
    return at(0.5) - (at(0.75) - at(0.5)) * REACH - slack


def learned_limits(rows: DataFrame, few: int = FEW) -> DataFrame:
    """(lang, source) with an upper and perhaps a lower limit of each share.

    Sketches are partial aggregates, so a frequent source meets in a bounded state per task.
    """
    measures = list(SHARES)
    own = rows.groupBy("lang", "source").agg(F.count("word_length").alias("n"), *[
        F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in measures])
    own = kept(own)
    by_lang = own.groupBy("lang").agg(F.sum("n").alias("lang_n"), *[
        F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(f"lang_{m}") for m in measures])
    every = own.agg(*[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(f"all_{m}")
                      for m in measures])
    joined = own.withColumnRenamed("lang", "own_lang").join(
        by_lang, F.col("own_lang").eqNullSafe(F.col("lang"))).join(F.broadcast(every))
    out = [F.col("own_lang").alias("limit_lang"), F.col("source").alias("limit_source")]
    for m, (above, below) in SHARES.items():
        sketch = F.when(F.col("n") >= few, F.col(m)).when(
            F.col("lang_n") >= few, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        known = F.when(F.kll_sketch_get_n_double(sketch) > 0, sketch)
        out.append(_limit(known, above, True).alias(f"{m}_above"))
        if below is not None:
            out.append(_limit(known, below, False).alias(f"{m}_below"))
    return joined.select(*out)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept; a share that is null or has no limit passes."""
    joined = rows.join(small(limits), F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col(
        "source").eqNullSafe(F.col("limit_source")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    good = ~failed
    for m, (_, below) in SHARES.items():
        good &= F.coalesce(F.col(m) <= F.col(f"{m}_above"), F.lit(True))
        if below is not None:
            good &= F.coalesce(F.col(m) >= F.col(f"{m}_below"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", good)


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    rows = pick(docs, doc_id=key, text=text, lang=lang, source=source)
    counted = kept(shares(measured(rows, "text")).drop("text"))
    return judged(counted, kept(learned_limits(counted))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def without_junk(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
                 ) -> DataFrame:
    """The rows that pass, with all their columns; counted in one pass, filtered in another."""
    rows, names = numbered(docs)
    rows = rows.withColumns({"lang": F.col(f"c{names.index(lang)}"),
                             "source": F.col(f"c{names.index(source)}")})
    counted = shares(measured(rows, f"c{names.index(text)}"))
    limits = kept(learned_limits(counted.select("lang", "source", *SHARES)))
    return restored(judged(counted, limits).where("kept"), names)
