"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D; texts are UTF-8, where these
bytes never occur inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = [0x20, *range(0x09, 0x0E)]
WORDS_SEED = 20240229

_rng = np.random.default_rng(WORDS_SEED)
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = int(_rng.integers(1, 2**62)) * 4 + 1  # odd, so it has an inverse modulo 2^64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[SPACES] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or powers of its inverse."""
    held = _POWERS.get(kind)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        held = np.ones(size, dtype=np.uint64)
        done = 1
        with np.errstate(over="ignore"):
            while done < size:  # doubling: the next block is the first one times base^done
                held[done:2 * done] = held[:done] * np.uint64(pow(base, done, 2**64))
                done *= 2
        _POWERS[kind] = held
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(
        column.type) else pa.binary()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(kind)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    step = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(offsets, step)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21, rows: int = 1 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into parts of at most ``rows`` rows and about ``most`` bytes of text.

    A part has one row at least; a longer text is never cut.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most or i - at == rows:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def find(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order.

    ``kind`` (by byte value) cuts words also between neighbours of the kinds 1 and 2.
    """
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]  # a text begins: nothing before it belongs to its first word
    if kind is not None and len(data):
        of = kind[data]
        first[1:] |= (of[1:] ^ of[:-1]) == 3
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True
           ) -> np.ndarray:
    """A 64-bit hash of each span; with ``fold`` A-Z count as a-z."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_FOLDED if fold else _BYTES)[data] * _powers("up", n + 1)[:n], out=sums[1:])
        value = (sums[ends] - sums[starts]) * _powers("down", n + 1)[starts]
        return mix(value ^ mix((ends - starts).astype(np.uint64) + np.uint64(1)))


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] for each (s, n), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return values[:0]
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
    return values[at]
