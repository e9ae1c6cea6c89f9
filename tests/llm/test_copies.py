"""Exact and near duplicates against plain restatements."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumbung.llm import components, exactdup, neardup
from lumbung.llm import words as W
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1000, 2**30), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    ordered = np.array(sorted(values), np.uint64)
    shift, zeros, rest = exactdup.golomb_encode(ordered, 1000, 2**30)
    assert (exactdup.golomb_decode(len(ordered), 1000, shift, zeros, rest) == ordered).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\t\n\x0b\x1f　x"), max_size=30), max_size=8))
def test_words_of_many_texts(texts):
    data, offsets = W.raw(pa.array([None, *texts], pa.string()))
    starts, ends, rows = W.find(data, offsets)
    got = [[] for _ in range(len(texts) + 1)]
    for s, e, r in zip(starts, ends, rows, strict=True):
        got[r].append(data[s:e].tobytes().decode())
    assert got == [[], *[brute.words(t) for t in texts]]
    hashes = W.hashes(data, starts, ends)
    flat = [brute.folded(w) for ws in got for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))


ROWS = [(1, "One text"), (2, "one TEXT"), (3, None), (4, ""), (5, "ÉTÉ"), (6, "été"), (7, "x" * 9000),
        (8, "x" * 9000), (9, "alone"), (10, "same row"), (10, "same row"), (None, "alone too"),
        (None, "one text"), (11, "one text "), (12, " ")]


def test_exact_groups(frame):
    rows = ROWS + [(100 + i, "copied text") for i in range(300)]
    docs = frame([(d, t, 0, "k") for d, t in rows],
                 "doc_id long, text string, Text int, digest string").repartition(5)
    got = exactdup.duplicate_groups(docs, owners=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == (
        sorted(brute.copies(rows), key=str))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_without_copies_keeps_columns(frame):
    rows = [(d, t, i) for i, (d, t) in enumerate(ROWS + [(20, "CoPied"), (21, "copied")])]
    docs = frame(rows, "doc_id long, text string, keep_id int")
    stay = exactdup.without_copies(docs)
    assert stay.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in stay.collect())
    assert got == sorted((str(d), t) for d, t in [
        (2, "one TEXT"), (4, ""), (5, "ÉTÉ"), (6, "été"), (8, "x" * 9000), (9, "alone"),
        (10, "same row"), (None, "alone too"), (11, "one text "), (12, " "), (21, "copied")])


def test_exact_empty(frame):
    assert exactdup.duplicate_groups(frame([])).collect() == []
    assert exactdup.without_copies(frame([])).collect() == []


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [(1, "Solo"), (2, "solo"), (3, "two words"), (4, "TWO  words"), (5, None), (6, " \n")]
    number = 10
    for size, copies, changes in ((60, 25, 2), (200, 8, 6), (30, 6, 1), (400, 5, 40)):
        base = text(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((number, " ".join(own)))
            number += 1
    chain = text(100)  # each links to the next, the ends do not link
    for i in range(12):
        rows.append((number, " ".join(chain)))
        chain = chain[4:] + [f"c{i}{j}" for j in range(4)]
        number += 1
    rows += [(number + i, " ".join(text(50))) for i in range(30)]
    rng.shuffle(rows)
    return rows


def check_near(got, rows, width, percent):
    component, sizes = brute.near(rows, width, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (d, sizes[d], component[d], component[d] == d) for d, _ in rows}


def test_near_duplicates(frame):
    rows = near_rows()
    for width, percent in ((2, 80), (5, 80)):
        docs = frame([(d, t, 1, "x") for d, t in rows],
                     "doc_id long, text string, cid int, signature string").repartition(4)
        check_near(neardup.near_duplicates(docs, width=width, percent=percent).collect(), rows,
                   width, percent)


def test_near_left_over_pairs(frame, monkeypatch):
    """With one-row bands all share buckets, so pairs besides those with the hub decide."""
    monkeypatch.setattr(neardup, "MINOR_BLOCK", 3)
    monkeypatch.setattr(neardup, "MEMBER_BLOCK", 4)
    monkeypatch.setattr(neardup, "BANDS", 128)
    monkeypatch.setattr(neardup, "ROWS", 1)
    rows = near_rows(5)
    check_near(neardup.near_duplicates(frame(rows), width=2, percent=80).collect(), rows, 2, 80)


def test_near_edge_cases(frame):
    assert neardup.near_duplicates(frame([])).collect() == []
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "q r s t u v"),
            (None, "only here and nowhere else")]
    got = neardup.near_duplicates(frame(rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([
        (None, 7, False), (7, 7, True), (7, 7, True), (8, 8, True), (None, None, True)], key=str)
    stay = neardup.without_near_copies(frame(
        [(3, "a b c d e f g", 1), (2, "A b c d e f g", 2), (4, "z", 3)],
        "doc_id long, text string, Text long"))
    assert sorted(r.doc_id for r in stay.collect()) == [2, 4]


def test_pruning_keeps_true_pairs():
    least = neardup.least_matches(80)
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.HASHES
    left = np.arange(neardup.HASHES, dtype=np.uint32)[None, :].repeat(2, axis=0)
    right = left.copy()
    right[1] += 1000
    assert neardup.survivors(left, right, 80).tolist() == [0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i + 1, i) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 200)]
    edges += [(x, y) for x, y in ((rng.randint(300, 400), rng.randint(300, 400))
                                  for _ in range(60)) if x > y]
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_dealt_out(spark, monkeypatch):
    """The same labels when no edge list counts as short."""
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (90, 7)],
                                  "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys([*range(41), 90], 0), 100: 100, 101: 100}


def test_one_id_on_two_texts(frame):
    """Ids name components; they do not join texts."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (2, one + " end"), (9, two + " end")]
    got = neardup.near_duplicates(frame(rows), width=2, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (5, 5), (9, 5)]


def test_drifting_chains(frame, monkeypatch):
    """Links that no hub has, inside tiles of a few members."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(150):  # slowly drifting texts that share most of their bands
        base = list(base) if i % 30 else [f"v{i}x{k}" if k > 25 else f"w{k}" for k in range(50)]
        base[rng.randrange(50)] = f"n{i}"
        rows.append((i, " ".join(base)))
    want = brute.near(rows, 1, 60)[0]
    for side in (4, 256):
        monkeypatch.setattr(neardup, "MINOR_BLOCK", side)
        monkeypatch.setattr(neardup, "MEMBER_BLOCK", 2 * side)
        got = neardup.near_duplicates(frame(rows), width=1, percent=60).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 1
