"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are at most the capacity, so a histogram of them is a bounded summary of any corpus. The
plan is made on that histogram: for each length, longest first, the missing rest is looked up among
single lengths, sums of two and sums of three, and combinations are used as often as their counts
allow; what stays goes to the tightest gap that holds it. A plan is a list of patterns with
repeat counts. Pieces then find their place in it by their rank among the pieces of their length.

Defined results: null text is empty and gives only the end id; a text with more ids than fit is cut
into full pieces and a rest; rows that repeat a document are packed one by one; an empty table gives
no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import kept, pick

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 700_000  # words whose ids a worker remembers (about 35 MB) before starting anew
LONG_WORD = 64  # longer words are encoded each time
MARKS = b".,;:!?%&$#*+()-"
CONTROL = b"<|"  # a word that has this is kept apart by letter case

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = PIECES + ", sequence_id long, offset long"


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[list(MARKS)] = 2

# -- token ids ------------------------------------------------------------------------------------

class WordEncoder:
    """Token ids of many texts by a tokenizer that never joins two words.

    Each word is encoded once and remembered by its 64-bit hash; texts are put together from the
    ids of their words. That equals encoding the whole text when white space separates tokens and
    contributes none, letter case of A-Z does not matter, and a letter A-Z and one of ``MARKS``
    next to it are never in one token. ``CONTROL`` keeps the spelling of special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(keys) > CACHED_WORDS:
            self.forget()
        found = self._encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        ids = np.fromiter((i for one in found for i in one), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offset of each text's ids."""
        starts, ends, rows = W.find(data, offsets, _KIND)
        keys = W.hashes(data, starts, ends, fold=CONTROL not in data.tobytes())
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        text = data.tobytes()
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        if len(self.known):
            fresh = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if fresh.any():
            sizes = (ends - starts)[first]
            if len(self.known) + int(fresh.sum()) > CACHED_WORDS:
                self.forget()
                fresh[:] = True
            short = np.flatnonzero(fresh & (sizes <= LONG_WORD))
            self._learn(distinct[short], [text[starts[i]:ends[i]].decode() for i in first[short]])
        at = np.searchsorted(self.known, distinct)
        place = np.minimum(at, max(0, len(self.known) - 1))
        held = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        ids, id_starts, id_sizes = self.ids, np.zeros(len(distinct), np.int64), np.zeros(
            len(distinct), np.int64)
        id_starts[held], id_sizes[held] = self.starts[place[held]], self.sizes[place[held]]
        missing = np.flatnonzero(~held)
        if len(missing):  # long words
            found = self._encode([text[starts[i]:ends[i]].decode() for i in first[missing]])
            more = np.fromiter(map(len, found), np.int64, len(found))
            id_starts[missing] = len(ids) + np.cumsum(more) - more
            id_sizes[missing] = more
            ids = np.concatenate([ids, np.fromiter((i for one in found for i in one), np.uint32,
                                                   int(more.sum()))])
        sizes = id_sizes[which]
        every = W.spread(ids, id_starts[which], sizes)
        per_row = np.bincount(rows, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        return every, np.concatenate([[0], np.cumsum(per_row)])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(path: str, capacity: int, with_ids: bool):
    """Pieces of each text's ids with their end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                ids, ends = encoder(path).encode(*W.raw(batch.column("text")))
                out: list[tuple] = []
                for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[ends[row]:ends[row + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        data = part.tobytes()
                        out.append((doc, piece, start, len(part), zlib.crc32(data),
                                    *([part] if with_ids else [])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32",
                         *(["ids"] if with_ids else [])]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                         pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds,
                                                         strict=False)], names)

    return cut


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and on demand its ids."""
    rows = pick(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(path, capacity, with_ids),
                           PIECES + (", ids array<long>" if with_ids else ""))


# -- the plan, on a histogram ---------------------------------------------------------------------

def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, copies), ...]) that use up ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    there = (left > 0).astype(np.float64)
    size = 2 * capacity + 2
    spectrum = np.fft.rfft(there, size)
    pairs = np.fft.irfft(spectrum * spectrum, size)[:capacity + 1] > 0.5  # sums of two lengths

    def use(parts: list[int]) -> bool:
        """Fills as many sequences with this combination as the counts allow."""
        need: dict[int, int] = {}
        for length in parts:
            need[length] = need.get(length, 0) + 1
        times = min(left[length] // n for length, n in need.items())
        if times == 0:
            return False
        for length, n in need.items():
            left[length] -= times * n
        out.append((int(times), sorted(need.items(), reverse=True)))
        return True

    def pair(total: int, spare: np.ndarray) -> tuple[int, int] | None:
        """The most uneven two available lengths with this sum."""
        low = np.arange(1, total // 2 + 1)
        ok = (spare[low] > 0) & (spare[total - low] > 0)
        if total % 2 == 0 and len(low):
            ok[-1] = spare[total // 2] > 1
        at = np.flatnonzero(ok)
        return (int(low[at[0]]), int(total - low[at[0]])) if len(at) else None

    for length in range(capacity, 0, -1):
        while left[length]:
            rest = capacity - length
            if rest == 0:
                use([length])
                continue
            if left[rest] and use([length, rest]):
                continue
            spare = left.copy()
            spare[length] -= 1
            found = None
            if rest > 1 and pairs[rest]:
                found = pair(rest, spare)
                if found is None and pair(rest, left) is None:
                    pairs[rest] = False  # lengths only run out, so this stays so
            if found is None and rest > 2:
                third = np.arange(rest - 2, 0, -1)
                third = third[(spare[third] > 0) & pairs[rest - third]]
                for one in third:
                    spare[one] -= 1
                    two = pair(rest - int(one), spare)
                    spare[one] += 1
                    if two is not None:
                        found = (*two, int(one))
                        break
                    if pair(rest - int(one), left) is None:
                        pairs[rest - int(one)] = False
            if found is None or not use([length, *found]):
                break

    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def reopen(gap: int, times: int, parts: list[tuple[int, int]]) -> None:
        gaps.setdefault(gap, []).append((times, parts))
        open_gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = np.flatnonzero(open_gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                times, parts = gaps[gap].pop()
                open_gaps[gap] = bool(gaps[gap])
            else:
                gap, times, parts = capacity, -(-n // (capacity // length)), []
            each = gap // length
            full = min(times, n // each)
            if full:
                reopen(gap - each * length, full, [*parts, (length, each)])
            n -= full * each
            if n and full < times:  # one more sequence takes what stays
                reopen(gap - n * length, 1, [*parts, (length, n)])
                full, n = full + 1, 0
            if full < times and (parts or len(fit)):
                reopen(gap, times - full, parts)
    for held in gaps.values():
        out.extend(held)
    return out


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that a pattern takes, with their place in it."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, parts in patterns:
        at = 0
        for length, copies in parts:
            first = taken.get(length, 0)
            rows.append((length, first, base, copies, at))
            taken[length] = first + times * copies
            at += length * copies
        base += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "copies", "at"), columns, strict=True))


def _assign(slots: dict[str, np.ndarray]):
    """Sequence and offset of each (length, rank); the table has a bounded number of rows."""
    # Ranks stay below 2^48; lengths below 2^15 go above them, so one search finds the range.
    keys = (slots["length"] << 48) | slots["first"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            turn = rank - slots["first"][at]
            copies = slots["copies"][at]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:5], pa.array(slots["base"][at] + turn // copies, pa.int64()),
                pa.array(slots["at"][at] + turn % copies * length, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return assign


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Ranks among equal lengths come from counts per stored partition, so pieces of one frequent
    length are ranked by as many tasks as there are partitions. The driver holds the histogram
    (at most ``capacity`` rows) and the plan made from it.
    """
    rows = kept(pieces).withColumn("part", F.spark_partition_id())
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(
        "base"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    slots = slot_table(plan_patterns(histogram, capacity))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(within) - 1).join(
        bases, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("own") + F.col("base")).cast("long").alias("rank"))
    return ranked.mapInArrow(_assign(slots), PLACES)
