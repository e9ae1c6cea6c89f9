"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbung.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [n, len(near), form, counts.get(form)]
    for w in counts:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return out


def collected(df):
    return {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in df.collect()}


WORDS = st.lists(st.text(st.sampled_from("aaabÿ"), min_size=1, max_size=9), min_size=1, max_size=12,
                 unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_near_pairs(left, right):
    found, prefix = variants.near_pairs(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert bool(found[i, j]) == one_edit(a, b)
            want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y),
                        min(len(a), len(b)))
            assert prefix[i, j] == want


@pytest.mark.parametrize("tile", [512, 3])
def test_against_all_pairs(frame, monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    stems += ["hotte" + c for c in "abcdefghijklmnopqrstuvÉé"] + ["z" * 5000, "z" * 5001]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(60))) for i in range(60)]
    rows += [(None, "Hottea HOTTEB,hotteb"), (None, None), (5, ""), (7, "-;1"), (8, "A" * 70000),
             (8, "A" * 70000), (8, "A" * 70000), (9, "same same"), (9, "same same"),
             (-4, "z" * 5000 + " " + "z" * 5001)] + [(1000 + i, "frequent frequenty") for i in
                                                   range(500)]
    docs = frame([(d, t, "k", 1) for d, t in rows],
                 "doc_id long, text string, word string, N int").repartition(4)
    want = plain(plain_counts(rows))
    assert collected(variants.spelling_variants(docs)) == want
    assert any(v[2] for v in want.values())


def test_chains_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96,
              "cccccd": 10, "cccccc": 10, "ccccc": 3, "ddddd": 5, "dddde": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = collected(variants.variants(words))
    assert got == plain(counts)
    assert got["aaaaa"][4] == "bbbbb"
    assert got["ccccc"][2] == "cccccc"


def test_few_rows(frame):
    assert variants.spelling_variants(frame([])).collect() == []
    assert collected(variants.spelling_variants(frame([(1, "single single single")]))) == {
        "single": [3, 0, None, None, "single"]}
