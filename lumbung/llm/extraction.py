"""Main text of web pages by the best contiguous region of a weighted token row.

A page becomes a row of tokens: tags and runs of words. Words weigh by the element they stand in,
tags by their name; the weights are log odds learned from all pages that mark their article
themselves (one ``article`` or ``main`` element). One linear scan finds the region of the greatest
sum. Inside it, elements that are boilerplate by their kind or name are left out, and the rest is
cut into blocks. A name counts by weights as well: log odds that elements of this name hold the
marked article, as against standing beside it. A name never leaves out an ``article`` or ``main``
element inside, nor more than half of the page's words.

Defined results: null html has no text; unclosed elements end with the element around them or with
the page; what follows an unclosed script, style or comment belongs to it; a tag whose quotes or bracket
stay open is text; character references are
decoded once; a page whose words all weigh negative has no text; repeated rows are read one by one;
an empty table gives no rows. Columns other than the key, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import pick

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s "
             "samp small span strike strong sub sup time tt u var wbr br img".split())
CELLS = set("td th".split())
MARKED = set("article main".split())
LEFT_OUT = set("nav footer aside form script style noscript template iframe button select option "
               "textarea input svg head title menu dialog object canvas audio video map "
               "datalist fieldset".split())
KNOWN = sorted(VOID | RAW | INLINE | CELLS | MARKED | LEFT_OUT | set(
    "html body header section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead "
    "tbody tfoot tr caption figure figcaption address details summary hgroup center".split()))
# Words in class, id or role that name boilerplate.
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
            "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header "
            "masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
            "overlay newsletter subscribe subscription signup login comment comments disqus "
            "respond reply replies share sharing social related recommended widget pagination "
            "pager skip search complementary contentinfo".split())
IN_HEAD = set("meta link title style script base noscript template".split())
# Elements that end an open paragraph or item.
ENDS_P = set("p div article main section ul ol dl table form blockquote pre h1 h2 h3 h4 h5 h6 hr "
             "header footer nav aside address figure fieldset details".split())
ENDS_SAME = {"li": "li", "dt": "dd", "dd": "dt", "option": "option", "tr": "tr", "td": "th",
             "th": "td"}
SCOPES = set("ul ol dl table select article main body div section".split())

CLIP = 6.0
DEFAULT_WORD, DEFAULT_TAG, DEFAULT_NAME = 1.0, -0.5, -1.0
Weights = dict[tuple[str, str, bool], float]

_OPENER = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
_NAME_END = re.compile(r"[\s/>]")
# Possessive, so that a tag without an end costs one look and no going back.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_SPECIAL = re.compile(r"[>\"']")
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))",
                   re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|"
                     r"display\s*:\s*none", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def boilerplate_names(attributes: str) -> set[str]:
    """Words for boilerplate in an element's class, id or role."""
    out: set[str] = set()
    if attributes.strip():
        for found in _NAME.finditer(attributes):
            value = next(v for v in found.groups() if v is not None)
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            out |= NAMES.intersection(_SPLIT.split(spaced))
    return out


class Markup:
    """Finds tags, comments and declarations in one pass over a page.

    A quoted value may hold ``>``. A tag whose quotes leave it without an end is text; whether that
    is so comes from a table that is filled from the page's end when the first such tag is met, so
    pages full of unmatched quotes take linear time too.
    """

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.places: list[int] | None = None  # of every > and quote
        self.ends: list[int] = []  # where a tag ends whose attributes go on at that place, or -1
        self.ending: list[int] = []  # the last place up to there from which a tag ends
        self.name_from, self.name_to = 0, -1

    def _look_ahead(self) -> None:
        page = self.page
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        n = len(self.places)
        self.ends = [-1] * (n + 1)
        following = {'"': n, "'": n}
        for i in range(n - 1, -1, -1):
            c = page[self.places[i]]
            if c == ">":
                self.ends[i] = self.places[i]
            else:
                close = following[c]
                self.ends[i] = self.ends[close + 1] if close < n else -1
                following[c] = i
        last = -1
        for i in range(n):
            last = i if self.ends[i] >= 0 else last
            self.ending.append(last)

    def _name_end(self, at: int) -> int:
        if not self.name_from <= at <= self.name_to:
            found = _NAME_END.search(self.page, at)
            self.name_from, self.name_to = at, found.start() if found else len(self.page)
        return self.name_to

    def _odd_tag(self, start: int) -> tuple[int, str, str, str] | None:
        """A tag with quotes in its name or without an end, by the table."""
        if self.places is None:
            self._look_ahead()
        closing = self.page[start] == "/"
        first = start + closing
        name_end = self._name_end(first)
        i = bisect_left(self.places, name_end)
        if i == len(self.places):
            return None
        if self.ends[i] < 0:  # perhaps a quote inside the name begins the attributes
            i = self.ending[i]
            if i < 0 or self.places[i] <= first:
                return None
            name_end = self.places[i]
        return (self.ends[i] + 1, "/" if closing else "", self.page[first:name_end].lower(),
                self.page[name_end:self.ends[i]])

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, "/" or "", name and attributes of the next one; no name: not an element."""
        page = self.page
        while found := _OPENER.search(page, at):
            start = found.start()
            if page.startswith("<!--", start):
                end = _COMMENT_END.search(page, start + 4)
                return start, end.end() if end else len(page), "", "", ""
            if start > self.last_end:
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            if page[start + 1] in "!?":
                return start, page.index(">", start + 1) + 1, "", "", ""
            tag = _TAG.match(page, start + 1) if self.places is None else None
            if tag:
                return start, tag.end(), tag[1], tag[2].lower(), tag[3]
            if odd := self._odd_tag(start + 1):
                return (start, *odd)
            at = start + 1
        return None


class Named:
    """An element with words for boilerplate in its name, and what it holds."""

    __slots__ = ("names", "marked", "parent", "words", "holds", "out")

    def __init__(self, names, marked, parent):
        self.names, self.marked, self.parent = names, marked, parent
        self.words, self.holds, self.out = 0, False, False

    def cut(self, weights: Weights, most: float) -> bool:
        """Its names weigh negative, and it holds no marked element and at most half the words."""
        return not self.holds and self.words <= most and sum(
            weights.get(("name", n, False), DEFAULT_NAME) for n in self.names) < 0


class Token:
    """A tag (``words`` 0) or a run of text, with the element it stands in."""

    __slots__ = ("kind", "words", "text", "out", "marked", "block")

    def __init__(self, kind, words, text, out, marked, block):
        self.kind, self.words, self.text = kind, words, text
        self.out, self.marked, self.block = out, marked, block


def tokens(page: str, weights: Weights | None = None) -> tuple[list[Token], list[Named]]:
    """Tags and texts in order, and the named elements.

    ``out``: boilerplate by kind or name; ``block``: ends a block.
    """
    row: list[Token] = []
    # Name, boilerplate by kind, inside a marked element, innermost block, depth of the scope.
    stack: list[tuple[str, bool, bool, str, int]] = []
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    open_named: list[tuple[int, Named]] = []  # depth in the stack
    named: list[Named] = []
    within: list[Named | None] = []  # the innermost one around each token
    at, markup = 0, Markup(page)

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def element() -> str:
        return stack[-1][3] if stack else "html"

    def close(depth: int) -> None:
        for entry in stack[depth:]:
            depths[entry[0]].pop()
        del stack[depth:]

    def holder() -> Named | None:
        while open_named and open_named[-1][0] >= len(stack):
            open_named.pop()
        return open_named[-1][1] if open_named else None

    def text(piece: str) -> None:
        if piece:
            within.append(holder())
            out, marked = state()
            plain = entities.unescape(piece)
            row.append(Token(("word", element(), out), len(plain.split()), plain, out, marked,
                             False))

    def tag(name: str, sign: str) -> None:
        out, marked = state()
        known = name if name in _KNOWN else "other"
        within.append(holder())
        row.append(Token(("tag", sign + known, out), 0, "", out, marked, name not in INLINE
                         and name not in CELLS))

    while found := markup.next(at):
        start, stop, sign, name, attributes = found
        text(page[at:start])
        at = stop
        if not name:
            continue
        if sign:
            if depths[name]:
                tag(name, "/")
                close(depths[name][-1])
            continue
        if name in ENDS_P or name in ENDS_SAME:
            ends = ("p",) if name in ENDS_P else (name, ENDS_SAME[name])
            depth = max((depths[n][-1] for n in ends if depths[n]), default=-1)
            if depth >= 0 and depth > stack[-1][4]:
                close(depth)
        if name not in IN_HEAD and depths["head"]:
            close(depths["head"][0])
        out, marked = state()
        marked_here = marked or name in MARKED
        plain = name in ("html", "body", *MARKED)
        left_out = out or name in LEFT_OUT or (name == "header" and not marked) or (
            not plain and bool(_HIDDEN.search(attributes)))
        if name in VOID or attributes.endswith("/") and name not in RAW:
            if name in VOID:
                tag(name, "")
            continue
        parent = holder()
        if name in MARKED and parent:
            parent.holds = True
        depths[name].append(len(stack))
        stack.append((name, left_out, marked_here, element() if name in INLINE else name,
                      len(stack) if name in SCOPES else stack[-1][4] if stack else -1))
        names = set() if plain else boilerplate_names(attributes)
        if marked:
            names.discard("header")  # an article's header has its title
        if names:
            named.append(Named(names, marked, parent))
            open_named.append((len(stack) - 1, named[-1]))
        tag(name, "")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            if name == "textarea" or name == "title":
                text(page[at:stop])
            at = stop
    text(page[at:] if at < len(page) else "")
    total = 0
    for t, x in zip(row, within, strict=True):
        if not t.out:
            total += t.words
            if x:
                x.words += t.words
    for x in reversed(named):
        if x.parent:
            x.parent.words += x.words
            x.parent.holds |= x.holds
    for x in named:
        x.out = bool(x.parent and x.parent.out) or x.cut(weights or {}, total / 2)
    for t, x in zip(row, within, strict=True):
        if x and x.out and not t.out:
            t.out, t.kind = True, (*t.kind[:2], True)
    return row, named


_KNOWN = set(KNOWN)


def label_counts(page: str) -> Counter:
    """(feature, inside the marked article) of a page that marks exactly one."""
    row, named = tokens(page)
    opens = sum(t.kind[0] == "tag" and t.kind[1] in MARKED for t in row)
    out: Counter = Counter()
    if opens != 1:
        return out
    for t in row:
        out[t.kind, t.marked] += t.words if t.kind[0] == "word" else 1
    for x in named:
        if not x.marked:  # inside the article, the marking does not tell what is boilerplate
            for n in x.names:
                out[("name", n, False), x.holds] += 1
    return out


def weights_of(counts: dict[tuple[tuple[str, str, bool], bool], int]) -> Weights:
    """Log odds of each feature; tags are never positive. Names: of elements around the article."""
    out: Weights = {}
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 1) / (counts.get((kind, False), 0) + 1))
        odds = max(-CLIP, min(CLIP, odds))
        out[kind] = odds if kind[0] == "word" else (
            odds if kind[0] == "name" else min(odds, 0.0)) - 0.1
    return out


def score(token: Token, weights: Weights) -> float:
    if token.kind[0] == "word":
        if token.out:  # left out of the text in any case, so it neither draws nor parts regions
            return 0.0
        return token.words * weights.get(token.kind, DEFAULT_WORD)
    return weights.get(token.kind, DEFAULT_TAG)


def best_region(values: list[float]) -> tuple[int, int]:
    """First and last+1 place of the contiguous part of greatest positive sum; the first one."""
    best, start, stop, total, begin = 0.0, 0, 0, 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best:
            best, start, stop = total, begin, i + 1
    return start, stop


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region without boilerplate, joined by an empty line."""
    if not page:
        return ""
    row, _ = tokens(page, weights)
    start, stop = best_region([score(t, weights) for t in row])
    blocks, held = [], []
    for t in row[start:stop]:
        if t.kind[0] == "word":
            if not t.out:
                held.append(t.text)
        elif t.block:
            blocks.append("".join(held))
            held = []
        elif t.kind[1].lstrip("/") in ("br", "td", "th", "img"):
            held.append(" ")
    blocks.append("".join(held))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            total.update(label_counts(page or ""))
    rows = [(k[0], k[1], k[2], inside, n) for (k, inside), n in total.items()]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
        ["kind", "name", "out", "inside", "n"])


def learned_weights(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from every page that marks its article; the driver gets a row per feature."""
    counts = pick(pages, html=html).mapInArrow(
        _counted, "kind string, name string, out boolean, inside boolean, n long").groupBy(
        "kind", "name", "out", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({((r["kind"], r["name"], r["out"]), r["inside"]): r["n"] for r in counts})


def _extracted(weights: Weights):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "html", most=1 << 23):
                texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return extract


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = learned_weights(pages, html) if weights is None else weights
    rows = pick(pages, page_id=key, url=url, html=html)
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extracted(weights), "page_id long, url string, text string, n_chars long")
