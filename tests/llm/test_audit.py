"""The filter interaction audit against a plain restatement."""

import random
import re
from itertools import permutations

from lumbung.llm import audit
from tests.llm import brute


def failed(rows):
    """The letters that each (doc_id, text, source) fails."""
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    out = []
    for d, t, _ in rows:
        text = t or ""
        words = brute.words(text)
        out.append({x for x, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
            ("D", re.search("[#$%&*|]", text) is not None),
            ("E", d is not None and d > smallest[text])) if bad})
    return out


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails, out = failed(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone),
                    sum(f == {x} for _, f in own), sum(d in good for d in gone),
                    sum(d in toxic for d in gone), x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


def build(frame, rows, labels):
    docs = frame([(d, t, s, "x", True) for d, t, s in rows],
                 "doc_id long, text string, source string, Part string, good boolean")
    marks = frame([(d, q, t, 1) for d, q, t in labels],
                  "doc_id long, quality int, toxic int, row int")
    return audit.failing(docs.repartition(3), marks)


def words(rng, n, kinds):
    return " ".join(rng.choice(kinds) for _ in range(n))


def test_against_orders(frame):
    rng = random.Random(4)
    many = [f"w{i}" for i in range(400)]
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (3, "", "a"), (None, "", "b"),
            (None, words(rng, 60, many), "a"), (4, "LOUD " * 60, "b"), (4, "LOUD " * 60, "b"),
            (5, "x" * 20000, "a"), (6, "\x0bword\x0c" + words(rng, 49, many) + "\r", "c")]
    for i in range(120):
        text = words(rng, rng.choice([20, 55, 80]), rng.choice([many, many[:30]]))
        text += rng.choice(["", "", " #", " UP" * 9, " $ " + "CAPITALS" * 6])
        rows.append((100 + i, text, rng.choice(["a", "a", "b", None, ""])))
    rows += [(300 + i, rng.choice(rows)[1], "a") for i in range(60)]
    rows += [(1000 + i, "one hot text", "hot") for i in range(80)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for d, _, _ in rows[::2]]
    labels += [(None, 1, 1), (4, 1, 0), (4, 0, 1), (77777, 1, 1)]
    got = {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in audit.interactions(build(frame, rows, labels)).collect()}
    assert got == plain(rows, labels)


def test_few_rows(frame):
    assert audit.interactions(build(frame, [], [])).collect() == []
    clean = " ".join(f"w{i}" for i in range(60))
    got = audit.interactions(build(frame, [(1, clean, None)], [])).collect()
    assert len(got) == 600
    assert {(r.part, r.kept, r.removed, r.redundant, r.shapley) for r in got} == {("", 1, 0, 0, 0)}
