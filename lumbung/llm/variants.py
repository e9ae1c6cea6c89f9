"""Spelling variants: words that differ by one code point, grouped under their most frequent form.

Words are compared in dense tiles. The words of a tile are rows of two matrices of code points,
padded once at the end and once at the beginning. Column by column, whole tiles are compared at
once: the length of the common prefix of every pair from the first matrix, that of the common suffix
from the second. Two words differ by exactly one inserted, deleted or replaced code point when the
two lengths together reach the longer word's length less one.

Prefix and suffix cannot both be shorter than half of the shorter word then, so only words that
share that half, at the same end, need to meet; this loses no pair. A block is one such half. It
holds the words of one length and those longer by one. A block of many words is cut into parts, and
every pair of parts is one tile; many small blocks are compared in one tile. A pair is counted at
its common prefix if that is long enough, else at its common suffix. No pair leaves a tile: it gives
each of its words the number of near words and the best of them, which are then added up.

Words are counted inside tasks before they are shuffled.

Defined results: null texts have no words; a null doc_id is written as nothing before the colon;
repeated rows count again; an empty table gives no rows; a word of any length is compared whole.
Columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import kept, partitions, pick

RUN = re.compile("[a-zÀ-ÿ]+")  # in text whose A-Z are lower-cased
TYPO = 97  # a run whose checksum it divides loses a code point
MIN_LENGTH, MIN_COUNT = 5, 3
HELD_WORDS = 300_000  # distinct words that a task counts before it passes them on
TILE = 512  # words on one side of a tile
POINTS = 1 << 21  # code points on one side of a tile; longer words make smaller tiles

COUNTS = "word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


# -- words and counts -----------------------------------------------------------------------------

class _Seen(dict):
    """Numbers the runs it is asked for; keeps their checksum and size in bytes."""

    def __init__(self):
        super().__init__()
        self.crc, self.size = array("Q"), array("Q")

    def __missing__(self, run: str) -> int:
        data = run.encode()
        self.crc.append(crc32(data))
        self.size.append(len(data))
        self[run] = code = len(self.crc) - 1
        return code


def _typos(prefixes: list[bytes], rows: np.ndarray, crc: np.ndarray, size: np.ndarray
           ) -> np.ndarray:
    """crc32(prefix + run) of each run, from the two parts' own checksums.

    A start value changes a checksum by an amount that depends only on it and on the run's size.
    """
    sizes, of = np.unique(size, return_inverse=True)
    pairs, where = np.unique(rows * len(sizes) + of, return_inverse=True)
    zeros = [bytes(int(s)) for s in sizes]
    plain = [crc32(z) for z in zeros]
    starts = [crc32(p) for p in prefixes]
    moved = np.fromiter((crc32(zeros[p % len(sizes)], starts[p // len(sizes)]) ^ plain[
        p % len(sizes)] for p in pairs.tolist()), np.uint64, len(pairs))
    return crc ^ moved[where]


def _counted(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals, made = _Seen(), np.zeros(0, np.int64), {}

        def packed() -> pa.RecordBatch:
            found = {w: n for w, n in zip(seen, totals.tolist(), strict=True)
                     if n and len(w) >= least}
            for w, n in made.items():
                found[w] = found.get(w, 0) + n
            return pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(found.values(), pa.int64())],
                ["word", "n"])

        for whole in batches:
            for batch in W.slices(whole, "text"):
                runs: list[str] = []
                ends = [0]
                for text in batch.column("text").to_pylist():
                    if text:
                        runs += RUN.findall(text.encode().lower().decode())  # only A-Z change
                    ends.append(len(runs))
                codes = np.fromiter(map(seen.__getitem__, runs), np.int64, len(runs))
                rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                keys = [b":" if d is None else b"%d:" % d
                        for d in batch.column("doc_id").to_pylist()]
                if len(runs):
                    sums = _typos(keys, rows, np.array(seen.crc, np.uint64)[codes],
                                  np.array(seen.size, np.uint64)[codes].astype(np.int64))
                    hit = sums % np.uint64(TYPO) == 0
                    for i in np.flatnonzero(hit).tolist():
                        run = runs[i]
                        at = int(sums[i]) % len(run)
                        word = run[:at] + run[at + 1:]
                        if len(word) >= least:
                            made[word] = made.get(word, 0) + 1
                    more = np.bincount(codes[~hit], minlength=len(seen))
                    more[:len(totals)] += totals
                    totals = more
                if len(seen) + len(made) > HELD_WORDS:
                    yield packed()
                    seen, totals, made = _Seen(), np.zeros(0, np.int64), {}
        yield packed()

    return count


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z in lower case.

    A run whose checksum with its doc_id is divisible by 97 loses one code point first.
    """
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                    "text")
    return rows.mapInArrow(_counted(min_length), COUNTS).groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- tiles ----------------------------------------------------------------------------------------

def _points(words: list[str], backwards: bool, pad: int) -> np.ndarray:
    """Code points of the words, one row each, padded at the end."""
    held = np.array([w[::-1] for w in words] if backwards else words)
    out = held.view(np.uint32).reshape(len(words), -1)
    return np.where(out == 0, np.uint32(pad), out) if pad else out


def _common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``left`` with every row of ``right``."""
    same = left[:, 0][:, None] == right[:, 0]
    total = same.astype(np.int32)
    for i in range(1, min(left.shape[1], right.shape[1])):
        same &= left[:, i][:, None] == right[:, i]
        if not same.any():
            break
        total += same
    return total


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs differ by one code point, and the lengths of all common prefixes.

    Words hold no code point 0, which pads the left side; the right side has another pad, so
    that padding never matches.
    """
    first, second = (np.fromiter(map(len, x), np.int32, len(x)) for x in (left, right))
    prefix = _common(_points(left, False, 0), _points(right, False, 0xFFFFFFFF))
    suffix = _common(_points(left, True, 0), _points(right, True, 0xFFFFFFFF))
    longer = np.maximum(first[:, None], second)
    different = (prefix < longer) | (first[:, None] != second)
    return (prefix + suffix >= longer - 1) & different & (
        np.abs(first[:, None] - second) <= 1), prefix


class _Tile:
    """Rows of one tile: one block, two parts of a large one, or several small ones."""

    def __init__(self, rows: pa.Table):
        self.words = rows.column("word").to_pylist()
        self.n = rows.column("n").to_numpy()
        self.block = rows.column("block").to_numpy()
        self.base = rows.column("base").to_numpy()
        self.suffix = rows.column("suffix").to_numpy(zero_copy_only=False)
        self.part, self.i, self.j = (rows.column(x).to_numpy() for x in ("part", "i", "j"))

    def near(self) -> dict[str, list]:
        """For each word with near words here: their number and the best of them."""
        split = self.i[0] != self.j[0]
        own, other = (np.flatnonzero(self.part == self.i[0]), np.flatnonzero(
            self.part == self.j[0])) if split else (np.arange(len(self.words)),) * 2
        out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
        if len(own) == 0 or len(other) == 0:
            return out
        ranked = [self._ranked(own), self._ranked(other)]
        found, prefix = near_pairs(*[[self.words[k] for k in side] for side in ranked])
        a, b = ranked
        length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        found &= self.block[a][:, None] == self.block[b]
        base = self.base[a]
        found &= (length[a] == base)[:, None] | (length[b] == self.base[b])
        found &= ~self.suffix[a][:, None] | (prefix < (base // 2)[:, None])
        self._add(out, a, b, found)
        if split:
            self._add(out, b, a, found.T)
        return out

    def _ranked(self, rows: np.ndarray) -> np.ndarray:
        """Most frequent words first, then in code-point order."""
        return np.array(sorted(rows.tolist(), key=lambda k: (-self.n[k], self.words[k])))

    def _add(self, out: dict, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> None:
        counts = found.sum(axis=1)
        hit = np.flatnonzero(counts)
        best = b[found[hit].argmax(axis=1)]
        out["word"] += [self.words[k] for k in a[hit]]
        out["n_near"] += counts[hit].tolist()
        out["best_n"] += self.n[best].tolist()
        out["best"] += [self.words[k] for k in best]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by block and tile; only the tile at work is held."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        found = _Tile(rows).near()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(
            found.values(), kinds, strict=True)], list(found))

    rest: pa.Table | None = None

    def cut(table: pa.Table, final: bool) -> tuple[list[pa.Table], pa.Table | None]:
        held = [table.column(x).to_numpy() for x in ("block", "i", "j")]
        new = np.zeros(len(table), bool)
        for x in held:
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(table)]
        sizes = np.maximum(table.column("base").to_numpy() + 1, 1)
        single = table.column("parts").to_numpy() == 1
        out, begin = [], 0  # small blocks are joined while a tile holds them
        for k in range(1, len(edges) - 1):
            a, b = edges[k], edges[k + 1]
            widest = int(sizes[begin:b].max())
            joined = single[begin] and single[a] and b - begin <= TILE and (
                b - begin) * widest <= POINTS
            if not joined:
                out.append(table.slice(begin, a - begin))
                begin = a
        if final:
            out.append(table.slice(begin))
            return out, None
        return out, table.slice(begin)  # the last tile may go on in the next batch

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        done, rest = cut(table.combine_chunks(), False)
        for tile in done:
            yield compared(tile)
    if rest is not None and len(rest):
        for tile in cut(rest.combine_chunks(), True)[0]:
            yield compared(tile)


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, block, base, suffix) of every block that a word belongs to."""
    word, length = F.col("word"), F.length("word")

    def half(longer: int, suffix: bool) -> Column:
        base = length - longer
        size = F.floor(base / 2).cast("int")
        key = F.right(word, size) if suffix else F.left(word, size)
        return F.struct(F.xxhash64(base, F.lit(suffix), key).alias("block"), base.alias("base"),
                        F.lit(suffix).alias("suffix"))

    return words.select("word", "n", F.inline(F.array(*[
        half(longer, suffix) for longer in (0, 1) for suffix in (False, True)])))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words; ``words``: (word, n)."""
    rows = kept(_halves(words))
    sizes = rows.groupBy("block").agg(
        F.count("*").alias("size"), F.max("base").alias("widest"),
        F.count(F.when(F.length("word") == F.col("base"), 1)).alias("bases")).where(
        "size > 1 and bases > 0")
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(POINTS) / (
        F.col("widest") + 1))))
    met = rows.join(sizes.select("block", F.ceil(F.col("size") / most).cast("int").alias(
        "parts")), "block").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    tiles = met.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
                       ).select("word", "n", "block", "base", "suffix", "parts", "part",
                                F.least("part", "with").alias("i"),
                                F.greatest("part", "with").alias("j"))
    found = tiles.repartition(partitions(words.sparkSession), "block", "i", "j"
                              ).sortWithinPartitions("block", "i", "j").mapInArrow(_tiles, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.low")).alias("best_n"), F.col("top.best").alias("best"))


# -- forms and roots ------------------------------------------------------------------------------

def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word that forms lead to.

    ``forms``: (word, form). Each round doubles the steps that a word has gone; a form has at
    least twice the word's count, so a chain is at most as long as the logarithm of the counts.
    """
    held = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(held.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias(
                "moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        held = moved.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word; ``words``: stored rows (word, n)."""
    near = near_words(words)
    led = F.col("best_n") >= 2 * F.col("n")
    own = kept(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")))
    roots = rooted(own.where("form is not null"))
    return own.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The variants of all words of the documents: word, n, n_near, form, form_n, root."""
    return variants(kept(word_counts(docs, key, text, min_length, min_count)))
