"""Byte-level BPE against the library on whole texts."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbung.llm import bytebpe, queries
from lumbung.llm import words as W

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aAst're'vellmd 1٣½ .,-<|>\n\t\r\x0b\x1c\x85 　é日ﬁ🙂́"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held,
                             special_tokens={})


def split(texts):
    data, offsets = W.raw(pa.array(texts, pa.string()))
    starts = bytebpe.word_starts(data, offsets)
    out = [[] for _ in texts]
    for a, b in zip(starts, [*starts, len(data)][1:], strict=True):
        row = int(np.searchsorted(offsets, a, side="right")) - 1
        out[row].append(data[a:b].tobytes().decode())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=14), st.text(
    st.characters(exclude_categories=("Cn", "Cs", "Co")), max_size=5)),
                max_size=6))
def test_words_as_matched(texts):
    assert bytebpe.PATTERN == public_tokenizers.PATTERN
    assert split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_every_character_as_the_library_splits(library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for a in range(0, len(points), 1 << 16):
        texts = ["".join(f"a{chr(p)} {chr(p)}1{chr(p)}'s" for p in points[a:a + 4096])]
        own = [i for w in split(texts)[0] for i in library.encode_ordinary(w)]
        assert own == library.encode_ordinary(texts[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_squeezed_round_trip(values):
    assert bytebpe.unsqueezed(bytebpe.squeezed(np.array(values, np.int64))).tolist() == values


TEXTS = [(1, "Plain words, it's 12 o'clock\n\n  and  more "), (2, None), (3, ""), (4, " \n \t"),
         (5, "日本語のテキスト 🙂"), (6, "x" * 30000), (6, "x" * 30000), (None, "no key"),
         (None, None), (7, "<|endoftext|> and 'll'll 've''s"), (8, "\x1c\x85  a"),
         (9, "word " * 5000), (-3, "'S 'T it'sit's 'tis")]


@pytest.mark.parametrize("size", [1 << 24, 64])
def test_documents(frame, library, monkeypatch, size):
    monkeypatch.setattr(bytebpe, "BLOCK_BYTES", size)
    rows = TEXTS + [(100 + i, "one hot text of many copies") for i in range(300)]
    docs = frame([(d, t, [1], "p") for d, t in rows],
                 "doc_id long, text string, ids array<int>, Part string").repartition(5)
    docs.persist()
    got = bytebpe.decoded(bytebpe.encoded(docs, PATH), PATH)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got.collect()) == sorted(
        (str(d), library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    digests = {r.doc_id: r for r in bytebpe.digests(got).collect()}
    ids = library.encode_ordinary(TEXTS[0][1])
    assert digests[1].n_tokens == len(ids)
    assert digests[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digests[1].decoded_sha256 == hashlib.sha256(TEXTS[0][1].encode()).hexdigest()
    assert (digests[2].n_tokens, digests[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    docs.unpersist()


def test_few_rows(frame, spark):
    assert bytebpe.encoded(frame([]), PATH).collect() == []
    assert [list(r.ids) for r in bytebpe.encoded(frame([(1, "")]), PATH).collect()] == [[]]
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in bytebpe.decoded(null, PATH).collect()] == [None]


def test_query_is_whole_and_lossless(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(
        f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
