"""Sharding and packing against plain restatements."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbung.llm import packing, sharding
from lumbung.llm import words as W

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_shards(frame):
    rng = random.Random(1)
    rows = [(i, "ß" * rng.randint(0, 60)) for i in range(500)] + [(500, None), (501, "x" * 700)]
    rows += [(None, "none"), (7, "again"), (7, "again")] + [(9, "hot")] * 300
    docs = frame([(d, t, 1) for d, t in rows], "doc_id long, text string, size int").repartition(6)
    got = sharding.balanced_shards(docs, 8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    by_shard = {s: [r for r in got if r.shard == s] for s in range(8)}
    last = -1
    for s in range(8):
        own = sorted(by_shard[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= most
        keys = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
    assert sum(r.rows for r in sharding.shard_sizes(sharding.balanced_shards(docs, 8)).collect()
               ) == len(rows)


def test_few_rows(frame):
    assert sharding.balanced_shards(frame([]), 4).collect() == []
    assert [(r.shard, r.slot) for r in sharding.balanced_shards(frame([(1, "a")]), 4).collect()
            ] == [(2, 0)]


ALPHABET = "aAbTé'sßIçΣς1٣ .,-<|>\n\t !?*&日ﬁ"
SPECIAL = "<|endoftext|>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=12), st.sampled_from([
    SPECIAL, SPECIAL.upper(), "it's", "WE'LL", "é", "x" * 80])), max_size=6).map("".join),
    max_size=5))
def test_words_encode_like_texts(texts):
    encoder = packing.encoder(PATH)
    ids, ends = encoder.encode(*W.raw(pa.array(texts, pa.string())))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_encoder_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 4)
    encoder = packing.WordEncoder(PATH)
    for texts in (["one two three", "four"], ["five six seven eight", "one"], ["two " * 9]):
        ids, ends = encoder.encode(*W.raw(pa.array(texts)))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.3 + 0.1 * seed)
    patterns = packing.plan_patterns(counts, capacity)
    used = np.zeros_like(counts)
    for times, parts in patterns:
        assert times > 0 and sum(a * n for a, n in parts) <= capacity
        for length, n in parts:
            used[length] += times * n
    assert (used == counts).all()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    large = int(counts[capacity // 2 + 1:].sum())  # no two of these fit together
    assert sum(t for t, _ in patterns) <= 1.15 * max(least, large) + 1


def test_packed(frame):
    rng = random.Random(2)
    rows = [(i, " ".join("abc"[rng.randrange(3)] for _ in range(rng.randint(0, 90))))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a b " * 150), (1003, "twin"), (1003, "twin")]
    rows += [(2000 + i, "same length here") for i in range(200)]
    docs = frame([(d, t, "x") for d, t in rows], "doc_id long, text string, rank string")
    got = packing.packed(packing.token_pieces(docs.repartition(5), PATH, capacity=100),
                         capacity=100).collect()
    tokenizer, want = packing.encoder(PATH).tokenizer, []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 100)):
            part = np.array(ids[start:start + 100], "<u4")
            want.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(sequences) <= -(-sum(x[3] for x in want) // 100) + 2
    assert packing.packed(packing.token_pieces(frame([]), PATH)).collect() == []
