"""Byte-level BPE ids of whole texts, each distinct word encoded once, and back again.

Texts are split into pre-tokens (here: words), whose ids never depend on their neighbours. A task
gathers its texts into blocks; a block is its distinct words and, for every document, the positions
of these words. Words go to the partition that their checksum names. Words of many blocks meet
there, each distinct one is encoded once, and the ids go back to the blocks that have it. In its
block, every document is put together again from its positions. A word crosses the network once per
block, and rows hold as many words as go the same way, so a frequent word moves no more than others.

The split is done on arrays of code points: a word starts where the kind of character changes
(letter, number, space, other); the last space before a word belongs to it if it is U+0020 and
stands alone otherwise; an apostrophe takes the ending of a contraction. That is what
``PATTERN`` matches (property test against the library).

Decoding joins ids with the table of token bytes, which has the size of the vocabulary.

Documents are read twice, once for their words and once for their positions, which moves less than
storing the words would. A block is named by a digest of its content, and the job fails when the
second reading gave other blocks: store a frame first whose rows or their order may change.

Defined results: null and empty texts have no ids; repeated rows are encoded one by one; a null
doc_id stays null; an empty table gives no rows; a text longer than a block is a block of its own.
Columns other than the key and the text are not read. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import partitions, pick

# Fixed value: the split that the vocabulary was made for.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLOCK_BYTES = 16 << 20  # text of a block
KNOWN_WORDS = 1 << 20  # words that an encoding task remembers before it starts anew
IDS_OUT = 1 << 20  # ids in one batch of results, a document at least

LISTS = "block long, part int, words int, sizes binary, data binary"
BLOCKS = LISTS + ", docs array<long>, lengths binary, positions binary"
IDS = "doc_id long, ids array<int>"


# -- pre-tokens -----------------------------------------------------------------------------------

OTHER, LETTER, NUMBER, BLANK = range(4)
_SPACE, _QUOTE = 0x20, 0x27


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point, asked of the library, whose Unicode tables decide.

    An encoding of single bytes keeps the characters that its pattern matches, and no others.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, own in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = tiktoken.Encoding("kind", pat_str=own, mergeable_ranks=single, special_tokens={})
        kept = bytes(found.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = kind
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of many texts start; every byte is in a word."""
    n_bytes = len(data)
    if n_bytes == 0:
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of every character
    n = len(points)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)  # a text starts here; so does what follows the last one
    first[np.searchsorted(places, offsets)] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    alone = np.flatnonzero((kind == BLANK) & ~first[1:])  # blanks with a character after them
    alone = alone[kind[alone + 1] != BLANK]
    start[alone] = True
    start[alone[points[alone] == _SPACE] + 1] = False

    quote = np.flatnonzero((points == _QUOTE) & start & run & ~first[1:])
    quote = quote[kind[quote + 1] == LETTER]
    a = points[quote + 1]
    after = np.minimum(quote + 2, n - 1)
    b = np.where(first[quote + 2], 0, points[after])
    two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | (
        (a == ord("l")) & (b == ord("l")))
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(two, 2, 0))
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    rest = rest[~first[rest]]
    start[rest[kind[rest] == LETTER]] = True
    return places[start]


class Block:
    """The distinct words of some texts and, for every text, the positions of its words."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = W.raw(batch.column("text"))
        starts = word_starts(data, offsets)
        ends = np.append(starts, len(data))[1:]
        hashes = W.hashes(data, starts, ends, fold=False)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        text, sizes = data.tobytes(), ends - starts
        if len(starts) and not (np.array_equal(sizes[one][which], sizes) and np.array_equal(
                W.spread(data, starts[one][which], sizes), data)):  # two words share a hash
            spelled = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            own = dict.fromkeys(spelled)
            number = {w: i for i, w in enumerate(own)}
            which = np.array([number[w] for w in spelled])
            found = list(own)
        else:
            found = [text[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(),
                                               strict=True)]
        codes = self.codes
        numbers = np.fromiter((codes.setdefault(w, len(codes)) for w in found), np.int64,
                              len(found))
        rows = np.searchsorted(starts, offsets)
        self.docs += batch.column("doc_id").to_pylist()
        self.lengths.append(np.diff(rows))
        self.positions.append(numbers[which])
        self.size += len(data)

    def close(self, parts: int) -> None:
        """Numbers the words by falling frequency, for small positions, and deals them out."""
        at = np.concatenate(self.positions)
        order = np.argsort(-np.bincount(at, minlength=len(self.codes)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.positions = [rank[at]]
        every = list(self.codes)
        self.words = [every[i] for i in order.tolist()]
        sums = np.fromiter(map(crc32, self.words), np.int64, len(self.words))
        self.part = sums % parts
        mark = blake2b(digest_size=8)
        for x in (sums, *self.lengths, *self.positions):
            mark.update(x.astype(np.int64).tobytes())
        mark.update(repr(self.docs).encode())
        self.number = int.from_bytes(mark.digest(), "little", signed=True)


def blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[Block]:
    """Blocks of a task's texts, the same whenever the task reads the same rows."""
    held = Block()
    for whole in batches:
        for batch in W.slices(whole, "text"):
            held.add(batch)
            if held.size >= BLOCK_BYTES:
                held.close(parts)
                yield held
                held = Block()
    if held.docs:
        held.close(parts)
        yield held


# -- compact columns ------------------------------------------------------------------------------

def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, plane by plane of their bytes."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    packed = [pa.compress(planes[:, i].tobytes(), codec="zstd", asbytes=True) for i in range(4)]
    head = np.array([len(values), *map(len, packed)], "<u8").tobytes()
    return head + b"".join(packed)


def unsqueezed(blob: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(blob[:40], "<u8").tolist()
    out, at = np.empty((n, 4), np.uint8), 40
    for i, size in enumerate(sizes):
        plane = pa.decompress(blob[at:at + size], n, codec="zstd", asbytes=True)
        out[:, i] = np.frombuffer(plane, np.uint8)
        at += size
    return out.reshape(-1).view("<u4").astype(np.int64)


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds_ = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
              "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds_[x.split()[1]])
                                       for i, x in enumerate(schema.split(", "))], names)


def _word_lists(parts: int):
    """One row per block and partition: the block's words that belong there, in its order."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, parts):
            order = np.argsort(block.part, kind="stable")
            edges = np.searchsorted(block.part[order], np.arange(parts + 1))
            rows = []
            for part in np.flatnonzero(np.diff(edges)).tolist():
                own = [block.words[i] for i in order[edges[part]:edges[part + 1]].tolist()]
                rows.append((block.number, part, len(own), squeezed(np.fromiter(
                    map(len, own), np.int64, len(own))), pa.compress(
                        b"".join(own), codec="zstd", asbytes=True)))
            yield _record(LISTS, rows)

    return lists


def _positions(parts: int):
    """One row per block: its documents, their positions, and the partition of each word."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, parts):
            yield _record(BLOCKS, [(
                block.number, parts, len(block.words), squeezed(block.part), None, block.docs,
                squeezed(np.concatenate(block.lengths)), squeezed(block.positions[0]))])

    return positions


# -- encoding -------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks(path),
                             special_tokens={})


def _encoded_lists(path: str):
    """The ids of every word of the lists; a word that has been met before is looked up."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        own = encoding(path).encode_ordinary
        for batch in batches:
            rows = []
            for number, part, n, sizes, data in zip(
                    *[c.to_pylist() for c in batch.columns], strict=True):
                ends = np.cumsum(unsqueezed(sizes))
                text = pa.decompress(data, int(ends[-1]), codec="zstd", asbytes=True)
                if len(known) + n > KNOWN_WORDS:
                    known.clear()
                ids: list[int] = []
                counts = []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    word = text[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = own(word.decode())
                    counts.append(len(found))
                    ids += found
                rows.append((number, part, n, squeezed(np.array(counts, np.int64)),
                             squeezed(np.array(ids, np.int64))))
            yield _record(LISTS, rows)

    return encode


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts documents together; a block's id lists stand before its row of positions.

    Blocks that are equal throughout have one number: their lists come twice and count once.
    """
    current, lists = None, {}
    for batch in batches:
        for number, part, n, sizes, data, docs, lengths, positions in zip(
                *[c.to_pylist() for c in batch.columns], strict=True):
            if number != current:
                current, lists = number, {}
            if docs is None:
                lists[part] = (n, sizes, data)
                continue
            if sum(x[0] for x in lists.values()) != n:
                raise RuntimeError("the documents were not the same when they were read again")
            counts, ids = ([np.concatenate([unsqueezed(x[i]) for x in lists.values()]) if lists
                            else np.zeros(0, np.int64) for i in (1, 2)])
            order = np.argsort(unsqueezed(sizes), kind="stable")
            starts, held = np.empty((2, n), np.int64)
            held[order], starts[order] = counts, np.cumsum(counts) - counts
            yield from _documents(docs, unsqueezed(lengths), unsqueezed(positions), ids, starts,
                                  held)


def _documents(docs: list, lengths: np.ndarray, at: np.ndarray, ids: np.ndarray,
               starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    totals = np.concatenate([[0], np.cumsum(sizes[at])])[ends]  # ids before each document
    a = 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(totals, totals[a] + IDS_OUT, side="right")) - 1)
        own = at[ends[a]:ends[b]]
        flat = W.spread(ids, starts[own], sizes[own])
        yield pa.RecordBatch.from_arrays([
            pa.array(docs[a:b], pa.int64()), pa.ListArray.from_arrays(
                pa.array((totals[a:b + 1] - totals[a]).astype(np.int32)),
                pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])
        a = b


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every document; ``path`` names a file of ranks that all workers have."""
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                    "text")
    parts = partitions(docs.sparkSession)
    lists = rows.mapInArrow(_word_lists(parts), LISTS).repartitionById(parts, F.col("part")
                                                                       ).mapInArrow(
        _encoded_lists(path), LISTS)
    every = lists.unionByName(rows.mapInArrow(_positions(parts), BLOCKS), allowMissingColumns=True)
    return every.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(
        _joined, IDS)


# -- decoding -------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, and where each id's bytes start and how many they are."""
    table = ranks(path)
    sizes = np.zeros(max(table.values(), default=-1) + 1, np.int64)
    tokens = sorted(table, key=table.__getitem__)
    for token in tokens:
        sizes[table[token]] = len(token)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded(path: str, names: list[str]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = _token_bytes(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            spelled = W.spread(data, starts[ids], sizes[ids])
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[
                np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [
                None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(
                    spelled.tobytes())])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(x) for x in names],
                pc.if_else(lists.is_valid(), texts.cast(pa.binary()), None)], [*names, "decoded"])

    return decode


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with a column ids) and the bytes that the ids spell; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoded(path, rows.columns), schema + ", decoded binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids (decimal, joined by commas) and of decoded bytes."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
