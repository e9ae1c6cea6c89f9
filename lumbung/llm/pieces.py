"""Sampled segmentation into the pieces of a SentencePiece model, and decoding.

A text's segmentations form a lattice: every piece that spells a stretch of it is an edge. The
probability of a segmentation is proportional to the product of its pieces' weights. Forward
filtering sums the weights of all ways to reach each position; backward sampling then walks from
the end, taking each edge with its share of that sum, so whole segmentations are drawn exactly. The
random number of a step depends on the seed, the row key and the position alone, so a row gets the
same pieces in any batch, partition or attempt.

Texts are cut first where no piece of the vocabulary crosses; every segmentation breaks there, so
the parts are independent. Equal parts share one lattice, and all parts of a batch are walked
together. A part of more than ``LONG_PART`` bytes, as in writing without blanks, is filtered and
walked alone, in blocks, and gets the same pieces. A character without a piece of its own is spelled by byte pieces. Blanks are the
vocabulary's U+2581 mark; that character itself is spelled by bytes, so decoding gives back every
text byte for byte. No blank is put before a text.

Defined results: null text is empty and has no pieces; rows that repeat key and text get the same
pieces; a null key counts as 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import pick

SHARPNESS = 1.0  # weight of a piece: 1 / (its rank + 1) to this power
SEED = 20240229
HELD_PARTS = 60_000  # parts whose lattices a worker keeps
CELLS = 1 << 20  # lattice cells that are filtered at once
PART_BYTES = 1 << 20  # text that is walked at once
LONG_PART = 1 << 12  # bytes; longer parts are filtered one by one, in blocks, and not kept
BLOCK = 1 << 16  # bytes of a long part that are looked up at once
TINY = 1e-200  # sums below it are scaled up
MARK = "▁"


def _pair(a: str, b: str) -> int:
    return int.from_bytes(a.encode(), "little") << 32 | int.from_bytes(b.encode(), "little")


class Vocabulary:
    """Pieces by length in bytes, with their hashes, ids and log weights."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.spelling: list[bytes] = [b""] * model.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        own = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.spelling[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace(MARK, " ")
                self.spelling[i] = plain.encode()
                own.append((len(plain.encode()), i, -model.get_score(i), plain))
        self.byte_weight = -sharpness * np.log(len(self.spelling) + 1.0)
        rank = np.argsort(np.argsort([score for _, _, score, _ in own], kind="stable"))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({n for n, _, _, _ in own}):
            at = [j for j, x in enumerate(own) if x[0] == length]
            data = np.frombuffer(b"".join(self.spelling[own[j][1]] for j in at), np.uint8)
            starts = np.arange(len(at)) * length
            keys = W.hashes(data, starts, starts + length, fold=False)
            order = np.argsort(keys)
            self.by_length[length] = (
                keys[order], np.array([own[j][1] for j in at])[order],
                -sharpness * np.log(rank[at] + 1.0)[order])
        self.single = {plain for _, _, _, plain in own if len(plain) == 1}
        crossed = np.zeros((256, 256), bool)
        pairs: set[int] = set()
        for _, _, _, plain in own:
            data = plain.encode()
            for a, b in zip(data, data[1:], strict=False):
                crossed[a, b] = True
            pairs.update(_pair(a, b) for a, b in zip(plain, plain[1:], strict=False)
                         if a > "\x7f" and b > "\x7f")
        crossed[128:, 128:] = True  # inside a character, or by the pair of characters below
        self.crossed = crossed
        self.crossed_pairs = np.array(sorted(pairs), np.uint64)
        self.longest = max(self.by_length)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts that no piece crosses."""
        first = np.ones(len(data), bool)
        first[1:] = ~self.crossed[data[:-1], data[1:]]
        first[self._between_characters(data)] = True
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], len(data))

    def _between_characters(self, data: np.ndarray) -> np.ndarray:
        """Where a character beyond ASCII follows another one and no piece crosses."""
        if not (data >= 0xC0).any():
            return np.zeros(0, np.int64)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        sizes = np.diff(heads, append=len(data))
        code = np.zeros(len(heads), np.uint64)
        for i in range(4):
            inside = np.flatnonzero(sizes > i)
            code[inside] |= data[heads[inside] + i].astype(np.uint64) << np.uint64(8 * i)
        high = (data[heads] >= 0xC0) & (sizes <= 4)
        at = np.flatnonzero(high[:-1] & high[1:]) + 1
        pairs = code[at - 1] << np.uint64(32) | code[at]
        return heads[at[~np.isin(pairs, self.crossed_pairs)]]

    def lacking(self, data: np.ndarray, text: bytes) -> np.ndarray:
        """Bytes of characters without a piece of their own."""
        out = np.zeros(len(data), bool)
        known = np.zeros(128, bool)
        for c in self.single:
            if ord(c) < 128:
                known[ord(c)] = True
        low = data < 128
        out[low] = ~known[data[low]]
        if not low.all():
            heads = np.flatnonzero((data & 0xC0) == 0xC0)
            sizes = 2 + (data[heads] >= 0xE0) + (data[heads] >= 0xF0)
            for head, size in zip(heads.tolist(), sizes.tolist(), strict=True):
                if text[head:head + size].decode(errors="replace") not in self.single:
                    out[head:head + size] = True
        return out


class Lattices:
    """Filtered lattices of distinct parts, as flat arrays of states and incoming edges."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.last = np.zeros(0, np.int64)  # final state of each part
        self.size = np.zeros(0, np.int64)  # its bytes
        self.first_edge = np.zeros(1, np.int64)  # of each state, and the number of edges
        self.share = np.zeros(0)  # cumulative share of an edge within its state
        self.back = np.zeros(0, np.int64)  # bytes the edge goes back
        self.piece = np.zeros(0, np.int64)

    def learn(self, vocabulary: Vocabulary, keys: np.ndarray, text: bytes, starts: np.ndarray,
              ends: np.ndarray) -> None:
        """Adds parts text[start:end] under their keys."""
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        found, at = [], 0
        while len(order) and sizes[order[-1]] > LONG_PART:
            part, order = order[-1:], order[:-1]
            found.append((part, *_filtered_long(
                vocabulary, text[starts[part[0]]:ends[part[0]]])))
        while at < len(order):
            longest = int(sizes[order[at]])
            take = max(1, CELLS // (longest + 1) ** 2)
            stop = min(len(order), at + take, int(np.searchsorted(
                sizes[order], max(longest + 1, longest * 5 // 4), side="left")))
            part = order[at:max(stop, at + 1)]
            found.append((part, *_filtered(vocabulary, text, starts[part], sizes[part])))
            at += len(part)
        states, edges = len(self.first_edge) - 1, len(self.share)
        firsts, lasts = [self.first_edge], np.zeros(len(keys), np.int64)
        for part, degree, _, _, _ in found:
            width = sizes[part] + 1
            lasts[part] = states + np.cumsum(width) - 1
            firsts.append(edges + np.cumsum(degree))
            states, edges = states + len(degree), edges + int(degree.sum())
        self.first_edge = np.concatenate(firsts)
        self.share = np.concatenate([self.share, *[f[2] for f in found]])
        self.back = np.concatenate([self.back, *[f[3] for f in found]])
        self.piece = np.concatenate([self.piece, *[f[4] for f in found]])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.last = np.insert(self.last, at, lasts)
        self.size = np.insert(self.size, at, sizes)


def _filtered(vocabulary: Vocabulary, text: bytes, starts: np.ndarray, sizes: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering of parts of similar size: edges into each state, with their shares."""
    n, longest = len(starts), int(sizes.max())
    data = np.frombuffer(b"".join(text[s:s + m].ljust(longest, b"\0") for s, m in zip(
        starts.tolist(), sizes.tolist(), strict=True)), np.uint8)
    lacking = vocabulary.lacking(data, data.tobytes()).reshape(n, longest)
    rows = np.arange(n)[:, None] * longest
    lengths = [m for m in vocabulary.by_length if m <= longest]
    ids, weights = {}, {}
    for m in lengths:
        begin = (rows + np.arange(longest - m + 1)).ravel()
        keys, pieces, weight = vocabulary.by_length[m]
        wanted = W.hashes(data, begin, begin + m, fold=False)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = (keys[at] == wanted).reshape(n, -1)
        hit &= np.arange(m, longest + 1) <= sizes[:, None]
        ids[m] = np.where(hit, pieces[at].reshape(n, -1), -1)
        weights[m] = np.where(hit, weight[at].reshape(n, -1), -np.inf)
    spelled = np.where(lacking, vocabulary.byte_weight, -np.inf)
    if 1 in ids:
        spelled = np.where(ids[1] >= 0, -np.inf, spelled)
        weights[1] = np.maximum(weights[1], spelled)
        ids[1] = np.where(np.isneginf(spelled), ids[1], vocabulary.byte[data].reshape(n, longest))
    total = np.full((n, longest + 1), -np.inf)
    total[:, 0] = 0
    ways = np.zeros((n, longest + 1, len(lengths)))
    for j in range(1, longest + 1):
        use = [(i, m) for i, m in enumerate(lengths) if m <= j]
        into = np.stack([total[:, j - m] + weights[m][:, j - m] for _, m in use], axis=1)
        top = into.max(axis=1)
        safe = np.where(np.isneginf(top), 0, top)
        mass = np.exp(into - safe[:, None])
        whole = mass.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            total[:, j] = np.where(whole > 0, np.log(whole) + safe, -np.inf)
            ways[:, j, [i for i, _ in use]] = np.where(
                whole[:, None] > 0, mass / whole[:, None], 0)
    inside = np.arange(longest + 1) <= sizes[:, None]
    state, place, which = np.nonzero(ways * inside[:, :, None])
    degree = np.bincount(state * (longest + 1) + place, minlength=n * (longest + 1)).reshape(
        n, -1)[inside]
    chance = ways[state, place, which]
    back = np.array(lengths)[which]
    piece = np.zeros(len(state), np.int64)
    for i, m in enumerate(lengths):
        own = which == i
        piece[own] = ids[m][state[own], place[own] - m]
    running = np.cumsum(chance)
    before = np.repeat((running - chance)[np.cumsum(degree[degree > 0]) - degree[degree > 0]],
                       degree[degree > 0])
    return degree, running - before, back, piece


def _filtered_long(vocabulary: Vocabulary, part: bytes
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering of one long part, block after block.

    A block starts from the sums of the positions that a piece can reach back to, divided by the
    greatest of them; shares within a state do not depend on that. Lookups take memory for one
    block; what stays is one entry per edge.
    """
    size, reach = len(part), vocabulary.longest
    sums = [0.0] * (reach - 1) + [1.0]  # of the last positions before the block
    degrees, shares, backs, pieces = [np.zeros(1, np.int64)], [], [], []
    for begin in range(0, size, BLOCK):
        stop = min(begin + BLOCK, size)
        low, high = max(0, begin - reach), min(size, stop + 3)
        while low and part[low] & 0xC0 == 0x80:
            low -= 1
        data = np.frombuffer(part, np.uint8)[low:high]
        lacking = vocabulary.lacking(data, part[low:high])
        ends, back, piece, weight = [], [], [], []
        for m, (keys, ids, weights) in vocabulary.by_length.items():
            first = np.arange(max(begin + 1 - m, 0), stop - m + 1) - low
            if not len(first):
                continue
            wanted = W.hashes(data, first, first + m, fold=False)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == wanted)
            if m == 1:
                lacking[first[hit]] = False
            ends.append(first[hit] + low + m)
            back.append(np.full(len(hit), m))
            piece.append(ids[at[hit]])
            weight.append(weights[at[hit]])
        spelled = np.flatnonzero(lacking[begin - low:stop - low]) + begin
        ends.append(spelled + 1)
        back.append(np.ones(len(spelled), np.int64))
        piece.append(vocabulary.byte[data[spelled - low]])
        weight.append(np.full(len(spelled), vocabulary.byte_weight))
        end, length = np.concatenate(ends), np.concatenate(back)
        order = np.lexsort((length, end))
        end, length = end[order], length[order]
        factor = np.exp(np.concatenate(weight)[order]).tolist()
        sums, share, degree = _forward(sums, end - begin, length, factor, stop - begin, reach)
        alive = share >= 0
        degrees.append(degree)
        shares.append(share[alive])
        backs.append(length[alive])
        pieces.append(np.concatenate(piece)[order][alive])
    return (np.concatenate(degrees), np.concatenate(shares), np.concatenate(backs),
            np.concatenate(pieces))


def _forward(sums: list[float], end: np.ndarray, length: np.ndarray, factor: list[float], size: int,
             reach: int) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Sums after a block, each edge's cumulative share (-1: from a state that none reaches) and
    the number of edges into each position. Edges come by end and length."""
    sums = sums + [0.0] * size
    share, degree = [-1.0] * len(factor), [0] * size
    source = (end + (reach - 1) - length).tolist()
    bounds = np.searchsorted(end, np.arange(1, size + 2)).tolist()
    for j in range(size):
        a, b = bounds[j], bounds[j + 1]
        whole = 0.0
        for e in range(a, b):
            if mass := sums[source[e]] * factor[e]:
                whole += mass
                share[e] = whole
                degree[j] += 1
        if whole:
            for e in range(a, b):
                if share[e] >= 0:
                    share[e] /= whole
            sums[reach + j] = whole
            if whole < TINY:
                window = slice(max(0, j + 1), reach + j + 1)
                top = max(sums[window])
                sums[window] = [x / top for x in sums[window]]
    last = sums[-reach:]
    top = max(last) or 1.0
    return [x / top for x in last], np.array(share), np.array(degree, np.int64)


def _uniform(keys: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row key, the position and the seed."""
    mixed = W.mix(W.mix(keys ^ np.uint64(seed)) ^ places.astype(np.uint64))
    return (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _walk_long(held: Lattices, state: int, end: int, stop: int, key: np.uint64, begin: int,
               seed: int, out: np.ndarray) -> None:
    """Backward sampling of one long part, block after block; ``begin`` is where its text begins."""
    while end > stop:
        low = max(stop, end - BLOCK)
        draws = _uniform(np.full(end - low, key), np.arange(low + 1, end + 1) - begin, seed).tolist()
        edges = held.first_edge[state - (end - low):state + 2]
        base = int(edges[0])
        share = held.share[base:edges[-1]].tolist()
        back = held.back[base:edges[-1]].tolist()
        first = (edges - base).tolist()
        at, chosen, ends = end, [], []
        while at > low:
            draw, edge, last = draws[at - low - 1], first[at - low], first[at - low + 1] - 1
            while edge < last and share[edge] <= draw:
                edge += 1
            chosen.append(edge)
            ends.append(at)
            at -= back[edge]
        out[np.array(ends) - 1] = held.piece[base + np.array(chosen)]
        state, end = state - (end - at), at


class Sampler:
    """Segmentations of many texts at once."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        self.vocabulary = Vocabulary(path, sharpness)
        self.held = Lattices()

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int = SEED
               ) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and the offset of each text's ids."""
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts, ends = self.vocabulary.parts(data, offsets)
        marks = W.hashes(data, starts, ends, fold=False)
        distinct, first, which = np.unique(marks, return_index=True, return_inverse=True)
        text = data.tobytes()

        def known() -> np.ndarray:
            if not len(self.held.keys):
                return np.zeros(len(distinct), bool)
            at = np.minimum(np.searchsorted(self.held.keys, distinct), len(self.held.keys) - 1)
            return self.held.keys[at] == distinct

        fresh = np.flatnonzero(~known())
        room = max(0, HELD_PARTS - len(self.held.keys))
        short = fresh[(ends - starts)[first[fresh]] <= LONG_PART]
        if len(short) and room:
            keep = short[:room]
            self.held.learn(self.vocabulary, distinct[keep], text, starts[first[keep]],
                            ends[first[keep]])
            fresh = np.setdiff1d(fresh, keep)
        out = np.full(len(data), -1, np.int64)
        is_known = known()
        self._walk(self.held, distinct, which, is_known, ends, offsets, keys, seed, out)
        if len(fresh):
            passing = Lattices()
            passing.learn(self.vocabulary, distinct[fresh], text, starts[first[fresh]],
                          ends[first[fresh]])
            self._walk(passing, distinct, which, ~is_known, ends, offsets, keys, seed, out)
        at = np.flatnonzero(out >= 0)
        return out[at], np.searchsorted(at, offsets)

    @staticmethod
    def _walk(held: Lattices, distinct, which, chosen, ends, offsets, keys, seed, out) -> None:
        """Backward sampling; writes each piece's id at its last byte."""
        parts = np.flatnonzero(chosen[which])
        if not len(parts):
            return
        where = np.searchsorted(held.keys, distinct[which[parts]])
        state, end = held.last[where], ends[parts].copy()
        row = np.searchsorted(offsets, end - 1, side="right") - 1
        stop = end - held.size[where]
        long = held.size[where] > LONG_PART
        for i in np.flatnonzero(long).tolist():
            _walk_long(held, int(state[i]), int(end[i]), int(stop[i]), keys[row[i]],
                       int(offsets[row[i]]), seed, out)
        state, end, row, stop = state[~long], end[~long], row[~long], stop[~long]
        while len(state):
            draw = _uniform(keys[row], end - offsets[row], seed)
            edge, last = held.first_edge[state], held.first_edge[state + 1] - 1
            going = np.flatnonzero((edge < last) & (held.share[edge] <= draw))
            while len(going):
                edge[going] += 1
                going = going[(edge[going] < last[going]) & (held.share[edge[going]] <= draw[going])]
            out[end - 1] = held.piece[edge]
            back = held.back[edge]
            end, state = end - back, state - back
            more = np.flatnonzero(end > stop)
            end, state, row, stop = end[more], state[more], row[more], stop[more]


@lru_cache(maxsize=1)
def sampler(path: str, sharpness: float = SHARPNESS) -> Sampler:
    return Sampler(path, sharpness)


def _lossless(spelling: list[bytes], ids: np.ndarray, ends: np.ndarray, data: np.ndarray,
              offsets: np.ndarray) -> np.ndarray:
    """Which texts their ids spell, byte for byte."""
    spelled, at = _bytes_of(spelling, ids, ends)
    same = np.diff(at) == np.diff(offsets)
    if same.all():
        wrong = np.flatnonzero(spelled != data)
        same[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return same
    return np.array([spelled[at[i]:at[i + 1]].tobytes() == data[offsets[i]:offsets[i + 1]].tobytes()
                     for i in range(len(same))])


def _encoded(path: str, seed: int, sharpness: float, checked: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", most=PART_BYTES):
                keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                data, offsets = W.raw(batch.column("text"))
                own = sampler(path, sharpness)
                ids, ends = own.encode(data, offsets, keys.astype(np.int64).view(np.uint64), seed)
                checks = [pa.array(_lossless(own.vocabulary.spelling, ids, ends, data, offsets))
                          ] if checked else []
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                             pa.array(ids.astype(np.int32))),
                    *checks], ["doc_id", "n_pieces", "ids", *(["lossless"] if checked else [])])

    return encode


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", seed: int = SEED,
            sharpness: float = SHARPNESS, checked: bool = False) -> DataFrame:
    """doc_id, n_pieces and ids of one sampled segmentation of every text.

    With ``checked`` also whether the ids, decoded, are the text again byte for byte.
    """
    rows = pick(docs, doc_id=key, text=text)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoded(path, seed, sharpness, checked),
        "doc_id long, n_pieces long, ids array<int>" + (", lossless boolean" if checked else ""))


def _bytes_of(spelling: list[bytes], ids: np.ndarray, ends: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids spell, and the offset of each text in them."""
    flat = np.frombuffer(b"".join(spelling), np.uint8)
    sizes = np.fromiter(map(len, spelling), np.int64, len(spelling))
    starts = np.cumsum(sizes) - sizes
    return W.spread(flat, starts[ids], sizes[ids]), np.concatenate(
        [[0], np.cumsum(sizes[ids])])[ends]


def _spelled(spelling: list[bytes], lists: pa.ListArray) -> pa.Array:
    """The texts that lists of ids spell, all at once."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(
        zero_copy_only=False).astype(np.int64)
    data, ends = _bytes_of(spelling, lists.flatten().to_numpy().astype(np.int64),
                           np.concatenate([[0], np.cumsum(counts)]))
    texts = pa.Array.from_buffers(pa.large_binary(), len(lists), [
        None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pc.if_else(lists.is_valid(), texts.cast(pa.large_string()).cast(pa.string()), None)


def _decoded(path: str, names: list[str]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = sampler(path).vocabulary.spelling
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                *[batch.column(n) for n in names], _spelled(spelling, batch.column("ids"))],
                [*names, "decoded"])

    return decode


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with a column ids) and the text that the ids spell; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoded(path, rows.columns), schema + ", decoded string")
