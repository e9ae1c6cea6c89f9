"""Plain restatements of the operators on small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def folded(text):
    return (text or "").translate(FOLD)


def shingles(text, width):
    found = words(folded(text))
    n = min(width, len(found))
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()


def near(docs, width, percent):
    """{doc_id: smallest reachable doc_id} by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def copies(rows):
    """(doc_id, keep_id, group_size, text_sha256) of every row."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[folded(t)].append(d)
    low = -10**30
    return [(d, max(groups[folded(t)], key=lambda x: low if x is None else x),
             len(groups[folded(t)]), hashlib.sha256(folded(t).encode()).hexdigest())
            for d, t in rows]


def counts(text):
    text = text or ""
    found = words(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = {j for i, w in enumerate(zip(found, found[1:], found[2:])) if windows[w] > 1
               for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(found), "word_chars": sum(map(len, found)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_capitals": sum("A" <= c <= "Z" for c in text), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
