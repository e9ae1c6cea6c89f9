"""Quality rules, chat, extraction, language id, scoring and pieces on small inputs."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbung.llm import chat, extraction, langid, lm, pieces, quality
from lumbung.llm import words as W
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- quality --------------------------------------------------------------------------------------

def share(a, b):
    return a / b if b else None


def verdicts(rows):
    """kept of (doc_id, text, lang, source) rows, by exact quantiles."""
    found = []
    for d, t, lang, source in rows:
        c = brute.counts(t)
        found.append((d, lang, source, c, {
            "word_length": share(c["word_chars"], c["n_words"]),
            "symbols": share(c["n_symbols"], c["n_words"]),
            "copied_lines": share(c["n_dup_lines"], c["n_lines"]),
            "repeated": share(c["n_repeat_words"], c["n_words"]),
            "capitals": share(c["n_capitals"], c["word_chars"])}))

    def limit(name, group, above):
        values = sorted(s[name] for s in group if s[name] is not None)
        if not values:
            return None

        def at(q):
            return values[max(0, math.ceil(q * len(values)) - 1)]

        up, down = quality.SHARES[name]
        if above:
            return at(.5) + (at(.5) - at(.25)) * quality.REACH + up
        return at(.5) - (at(.75) - at(.5)) * quality.REACH - down

    out = {}
    for d, lang, source, c, own in found:
        groups = [[s for _, a, b, _, s in found if (a, b) == (lang, source)],
                  [s for _, a, _, _, s in found if a == lang], [s for *_, s in found]]
        groups = next((g for g in groups if sum(s["word_length"] is not None for s in g)
                       >= quality.FEW), groups[-1])
        good = c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]
        for name, (_, down) in quality.SHARES.items():
            for above in (True, False) if down is not None else (True,):
                bound = limit(name, groups, above)
                if own[name] is not None and bound is not None:
                    good &= own[name] <= bound if above else own[name] >= bound
        out[d] = (good, c)
    return out


def quality_rows():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        text = [rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randint(0, 999))
                for _ in range(rng.randint(20, 120))]
        if i % 11 == 0:
            text = [w + "&&&" for w in text]
        if i % 13 == 0:
            text = [w.upper() for w in text]
        if i % 17 == 0:
            text = text[:20] * 4
        if i % 19 == 0:
            text = ["\n".join(text[:6])] * 4 + text
        rows.append((i, rng.choice([" ", "\n", "\t", "\x0b "]).join(text),
                     ["aa", "bb", None][i % 3 if i < 200 else 0], ["s", "t", None][i % 7 % 3]))
    return rows + [(900, None, "aa", "s"), (901, "", None, None), (902, " é " * 60, "zz", "q"),
                   (903, " lead  and trail ", "bb", "t")]


def test_quality(frame):
    rows = quality_rows()
    docs = frame([(*r, 5, True) for r in rows],
                 "doc_id long, text string, lang string, source string, n_words int, KEPT boolean")
    want = verdicts(rows)
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        good, c = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(
            c[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r.kept == good and not (r.kept and r.base_failed)
    stay = quality.without_junk(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(d for d, v in want.items() if v[0])


def test_quality_empty(frame):
    empty = frame([], "doc_id long, text string, lang string, source string")
    assert quality.quality_verdicts(empty).collect() == []
    assert quality.without_junk(empty).collect() == []


# -- chat -----------------------------------------------------------------------------------------

TRICKY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\INST]", "</s", "", None, "a\nb", "$1 \\1",
          "<\\/s> [/INST]]", "😀 é", "x" * 700, "[INST]" * 50]


def conversation_rows():
    rows = [(c, t, ["system", "user", "assistant"][(c + t) % 3], TRICKY[(3 * c + t) % len(TRICKY)])
            for c in range(15) for t in range(c % 6 + 1)]
    return rows + [(50, 0, None, "who"), (50, 1, "<s>", "role"), (None, 0, "assistant", "lost"),
                   (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]


def test_chat_round_trip(frame):
    rows = conversation_rows()
    turns = frame([(*r, "x") for r in rows],
                  "conv_id long, turn long, role string, text string, kind string").repartition(4)
    written = chat.rendered(chat.folded(chat.conversation_log(turns, chunk=7)))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(written)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_log_events(frame):
    schema = "conv_id long, seq long, kind string, message int, role string, text string"
    log = [
        (1, 1, "open", 1, "user", "Hi"), (1, 2, "open", 2, "assistant", "Dra"),
        (1, 3, "delta", 2, None, "ft"), (1, 4, "open", 3, "user", "More"),
        (1, 5, "edit", 1, None, "Hello"), (1, 6, "regenerate", 2, None, None),
        (1, 7, "delta", 2, None, "Fi"), (1, 8, "delta", 2, None, "nal"),
        (1, 8, "delta", 2, None, "nal"), (1, 9, "open", 3, "user", "Thanks"),
        (1, 10, "delta", 3, None, None), (2, 1, "open", 1, "user", None)]
    random.Random(1).shuffle(log)
    got = chat.folded(frame(log, schema).repartition(3)).collect()
    assert sorted((r.conv_id, r.message, r.role, r.text) for r in got) == [
        (1, 1, "user", "Hello"), (1, 2, "assistant", "Final"), (1, 3, "user", "Thanks"),
        (2, 1, "user", "")]
    out = {r.conv_id: r for r in chat.rendered(chat.folded(frame(log, schema))).collect()}
    assert out[1].formatted == (
        "<s>user[INST]Hello</s><s>assistant[/INST]Final</s><s>user[INST]Thanks</s>")
    assert [out[1].formatted[s.start:s.start + s.length] for s in out[1].loss] == ["Final"]
    assert chat.rendered(chat.folded(frame([], schema))).collect() == []


def plainly_folded(log):
    """The log's meaning, event by event: what a later regeneration voids never happened."""
    events = sorted(set(log), key=lambda e: e[1])
    out = {}
    for conv, seq, kind, message, role, text in events:
        if any(e[0] == conv and e[2] == "regenerate" and e[1] > seq and e[3] < message
               for e in events):
            continue
        held = out.setdefault((conv, message), ["", ""])
        if kind == "open":
            held[0] = role or ""
        held[1] = {"delta": held[1] + (text or ""), "regenerate": ""}.get(kind, text or "")
    return sorted((*k, *v) for k, v in out.items())


def test_chat_folding_equals_plain_replay(frame):
    schema = "conv_id long, seq long, kind string, message int, role string, text string"
    source = random.Random(5)
    log = []
    for conv in range(40):
        for seq in range(source.randrange(1, 30)):
            log.append((conv, seq, source.choice(["open", "delta", "delta", "edit", "regenerate"]),
                        source.randrange(5), source.choice(["user", "assistant", None]),
                        source.choice(["a", "bc", "", None])))
    log += source.sample(log, 20)
    source.shuffle(log)
    got = chat.folded(frame(log, schema).repartition(5)).collect()
    assert sorted((r.conv_id, r.message, r.role, r.text) for r in got) == plainly_folded(log)


def test_long_conversation(spark):
    """40,000 turns, spans over block borders and astral characters; time in proportion."""
    def turns(n):
        i = F.col("id")
        return spark.range(n).select(
            F.lit(1).alias("conv_id"), i.alias("turn"),
            F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.when(i == 7, F.repeat(F.lit("😀x</s>"), 3000)).otherwise(F.concat(
                F.lit("é[INST] "), i.cast("string"))).alias("text"))

    def fold(n):
        start = time.perf_counter()
        row = chat.digests(chat.read_back(chat.rendered(chat.folded(
            chat.conversation_log(turns(n)))))).first()
        return row, time.perf_counter() - start

    fold(100)
    row, seconds = fold(40_000)
    loss = "".join("😀x</s>" * 3000 if i == 7 else f"é[INST] {i}" for i in range(1, 40_000, 2))
    assert row.n_turns == 40_000
    assert (row.loss_chars, row.loss_sha256) == (
        len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert seconds < 30


# -- extraction -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, always and for everything</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;<b>bold</b>   word<br>next &#233;&lt;tag&gt;
<p>Second <a href="x">link</a>.<script>var t="</p>";</script>
<aside>Read also this</aside><div class="share-buttons">Share it</div>
<form><label>Mail</label><input name="q"></form><blockquote>Quoted</blockquote>
<ul><li>One<li>Two</ul><section id="comments"><p>Reader says hi</p></section></article>
<div id="sidebar"><p>Popular</p></div><!-- <p>hidden</p> --><footer>&copy; Us</footer></body></html>"""
TEXT = ["Title & more", "First bold word next é<tag>", "Second link.", "Quoted", "One", "Two"]


def test_extraction(frame):
    other = PAGE.replace("<article>", "<div class='story'>").replace("</article>", "</div>")
    pages = [(i, "u", PAGE.replace("Quoted", f"Quoted {i}")) for i in range(30)]
    pages += [(100, None, other), (101, "u", None), (102, "u", ""), (103, "u", "<p>cut <b>off"),
              (104, "u", "<nav>only</nav>"), (105, "u", "plain words &am &amp"), (None, "u", PAGE)]
    rows = frame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extraction.main_texts(rows).collect()}
    assert got[3].text == "\n\n".join(TEXT).replace("Quoted", "Quoted 3")
    assert got[None].text == "\n\n".join(TEXT) and got[None].n_chars == len(got[None].text)
    assert got[100].text == "\n\n".join(TEXT)
    assert [got[i].text for i in (101, 102, 103, 104, 105)] == [
        "", "", "cut off", "", "plain words &am &"]
    empty = frame([], "page_id long, url string, html string")
    assert extraction.main_texts(empty).collect() == []


WRAPPERS = ["<div class='content has-sidebar'>", "<div class='layout-sidebar-right'>",
            "<div class='page no-comments'>", "<section class='post-with-related'>",
            "<div class='social-science'>", "<div id='search-results'>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_extraction_named_wrapper(wrapper, inner):
    """A name on an element around the article, or around most words, leaves nothing out."""
    close = f"</{wrapper[1:].split()[0]}>"
    page = (f"<body><nav>Home</nav>{wrapper}<{inner}><h1>The whole title here</h1>"
            f"<p>First of the words.</p><div class='share-buttons'>Share</div></{inner}>{close}</body>")
    assert extraction.main_text(page, {}) == "The whole title here\n\nFirst of the words."


@pytest.mark.parametrize("name", ["entry-header", "post-header"])
def test_extraction_title_in_header(name):
    page = (f"<article><div class='{name}'><h1>The whole title here</h1></div>"
            "<p>Some words of text</p></article>")
    assert extraction.main_text(page, {}) == "The whole title here\n\nSome words of text"


def test_extraction_learns_names():
    """A name that stands around articles does not leave out a small part; one beside them does."""
    counts = extraction.label_counts(
        "<div class='social-science'><article>a b c</article></div><div class='related'>x</div>")
    weights = extraction.weights_of(counts)
    page = "<article>a b c d<div class='social-science'>e</div><p class='related'>f</p></article>"
    assert extraction.main_text(page, weights) == "a b c d\n\ne"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4).map(float), max_size=12))
def test_best_region(values):
    start, stop = extraction.best_region(values)
    best = max([sum(values[a:b]) for a in range(len(values)) for b in range(a, len(values) + 1)],
               default=0)
    assert sum(values[start:stop]) == max(0, best)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/!-pab &;\"'= \n"), max_size=60))
def test_any_markup(page):
    extraction.main_text(page, {})


PLAIN_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("<<>/!-ab\"\"'= "), max_size=24))
def test_markup_equals_its_plain_statement(page):
    got, markup, at = [], extraction.Markup(page), 0
    while found := markup.next(at):
        got.append(found)
        at = found[1]
    assert got == [(m.start(), m.end(), m[1] or "", (m[2] or "").lower(), m[3] or "")
                   for m in PLAIN_MARKUP.finditer(page)]


@pytest.mark.parametrize("unit", [
    '<a b="x ', "<i>", "<p><b>", "<a<a", '<a"<a" ', "<!", "<li><b>", "<b><h1>x</h1>", "</q><u>x",
    "<div class='", "<!-- ", "<head ", "<title>"])
def test_markup_is_linear(unit):
    def seconds(size):
        begun = time.process_time()
        extraction.main_text(unit * (size // len(unit)), {})
        return time.process_time() - begun

    assert seconds(1 << 20) < 12 * seconds(1 << 17) + 1


# -- language id ----------------------------------------------------------------------------------

def test_language_rules(frame):
    rows = [(i, ["der hund und die katze", "le chien et la souris là"][i % 2] + f" {i}",
             ["de", "fr"][i % 2]) for i in range(60)]
    rows += [(100, None, "de"), (101, "123 !?", "fr"), (102, "", None), (103, "DER HUND UND", None),
             (104, "é", None)]
    docs = frame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.language_ids(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    for d, text, lang in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= got[d].score <= 1
        if d in (100, 101, 102):
            assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
        elif lang:
            assert got[d].lang_pred == lang
    assert got[103].lang_pred == "de" and got[104].lang_pred == "fr"
    stay = langid.in_known_language(docs)
    assert stay.columns == docs.columns
    assert {100, 101, 102}.isdisjoint(r.doc_id for r in stay.collect())


def test_language_without_training(frame):
    schema = "doc_id long, text string, lang string"
    assert langid.language_ids(frame([], schema)).collect() == []
    got = langid.language_ids(frame([(1, "words", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where(
        "held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


# -- language model -------------------------------------------------------------------------------

def lm_rows():
    rng = random.Random(6)
    return [(i, " ".join(itertools.chain.from_iterable(
        (["red", "fox"] if rng.random() < .5 else ["blue", "whale"]) + [f"w{rng.randint(0, 60)}"]
        for _ in range(rng.randint(1, 40))))) for i in range(200)] + [
        (500, None), (501, ""), (502, "Unseen WORDS here"), (503, "RED fox\tred\x0bfox")]


def test_lm_base_score(frame):
    rows = lm_rows()
    docs = frame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    got = {r.doc_id: r for r in lm.scores(docs.repartition(4)).collect()}
    tokens = {d: [brute.folded(w) for w in brute.words(t)] + [None] for d, t in rows}
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = {}
    for d, own in tokens.items():
        if d not in held:
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for d, own in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            d in held, len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(
            math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own))
    gain = [got[d].score - got[d].base_score for d in held]
    assert sum(gain) > 0
    assert all(r.score < 0 for r in got.values())
    assert lm.scores(frame([])).collect() == []
    untaught = lm.scores(frame([(16, "a b")]).where("doc_id > 0")).collect()
    assert len(untaught) == 1


def test_lm_is_normalised():
    noise = np.random.default_rng(1).random(lm.BUCKETS)
    noise /= noise.sum()
    model = lm.untrained(noise)
    keys = np.arange(0, lm.BUCKETS**2, 977) * lm.BUCKETS + 5
    for number in range(40):
        model = lm.train_locally(model, noise, keys, np.full(len(keys), 3), number)
    scorer = lm.Scorer(model)
    for context in (0, 5, lm.BUCKETS * 17 + 3):
        every = np.arange(lm.BUCKETS)
        assert (10 ** scorer.log10(np.full(lm.BUCKETS, context), every)).sum() == pytest.approx(
            1, abs=1e-5)
    assert 10 ** scorer.log10(np.array([977]), np.array([5]))[0] > 0.5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=9000), st.integers(0, 9))
def test_lm_pass_uses_every_count(counts, seed):
    counts = np.array(counts)
    row, weights = lm.whole_pass(counts, np.random.default_rng(seed))
    used = np.bincount(row, weights=weights, minlength=len(counts))
    assert used / used.sum() == pytest.approx(counts / counts.sum(), rel=1e-4)
    assert len(row) <= len(counts) + lm.HEAVY * (1 + len(counts) / lm.MINIBATCH)


def test_lm_learns_a_rare_count():
    """A count of one among heavy ones moves its own context in every pass."""
    noise = np.full(lm.BUCKETS, 1 / lm.BUCKETS)
    keys = np.arange(5000) * lm.BUCKETS + 7
    counts = np.full(len(keys), 10**6)
    keys[-1], counts[-1] = 400 * lm.BUCKETS**2 + 300 * lm.BUCKETS + 9, 1
    before = lm.untrained(noise)
    after = lm.train_locally(before, noise, keys, counts, 0)
    assert (after["context"][[300, 400]] != before["context"][[300, 400]]).any(axis=1).all()


def test_lm_is_independent_of_partitioning(frame):
    docs = frame(lm_rows())
    three, seven = ({r.doc_id: r.score for r in lm.scores(docs.repartition(n)).collect()}
                    for n in (3, 7))
    assert three == pytest.approx(seven, rel=1e-6)


def test_lm_rare_words_are_joined(frame, monkeypatch):
    """With few counts sent along, the others come from the join and give the same scores."""
    docs = frame(lm_rows())
    want = {r.doc_id: (r.n_known, r.base_score) for r in lm.scores(docs).collect()}
    monkeypatch.setattr(lm, "SENT_WORDS", 3)
    got = {r.doc_id: (r.n_known, r.base_score) for r in lm.scores(docs).collect()}
    for d, (known, base) in want.items():
        assert got[d] == (known, pytest.approx(base))


# -- pieces ---------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthe  éñ▁日😀\n\t.,!\x00ß́"), max_size=40),
                max_size=5))
def test_pieces_round_trip(texts):
    sampler = pieces.sampler(PIECES)
    data, offsets = W.raw(pa.array(texts, pa.string()))
    keys = np.arange(len(texts)).astype(np.uint64)
    ids, ends = sampler.encode(data, offsets, keys)
    spelling = sampler.vocabulary.spelling
    assert [b"".join(spelling[i] for i in ids[a:b]).decode() for a, b in zip(
        ends[:-1], ends[1:], strict=True)] == texts


def test_pieces_are_drawn_by_weight():
    sampler = pieces.Sampler(PIECES)
    word, n = " the", 20000
    data, offsets = W.raw(pa.array([word] * n))
    ids, ends = sampler.encode(data, offsets, np.arange(n).astype(np.uint64))
    drawn = {}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        drawn[tuple(ids[a:b].tolist())] = drawn.get(tuple(ids[a:b].tolist()), 0) + 1
    weight = {}
    for keys, own, logs in sampler.vocabulary.by_length.values():
        weight.update(zip(own.tolist(), logs.tolist(), strict=True))
    spell = {sampler.vocabulary.spelling[i]: i for i in weight}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for m in range(1, len(rest) + 1):
            if rest[:m] in spell:
                for more, w in ways(rest[m:]):
                    yield (spell[rest[:m]], *more), w + weight[spell[rest[:m]]]

    every = {k: math.exp(w) for k, w in ways(word.encode())}
    total = sum(every.values())
    assert set(drawn) <= set(every)
    for k, w in every.items():
        share = w / total
        assert abs(drawn.get(k, 0) / n - share) < 5 * math.sqrt(share / n) + 1e-3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("thean é日本語приет😀"), max_size=60), max_size=4))
def test_long_parts_are_the_same_in_blocks(texts):
    data, offsets = W.raw(pa.array(texts, pa.string()))
    keys = np.arange(len(texts)).astype(np.uint64)
    want = pieces.sampler(PIECES).encode(data, offsets, keys)
    held = pieces.LONG_PART, pieces.BLOCK
    try:
        pieces.LONG_PART, pieces.BLOCK = 3, 5
        small = pieces.Sampler(PIECES)
        got = small.encode(data, offsets, keys)
    finally:
        pieces.LONG_PART, pieces.BLOCK = held
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert not (small.held.size > 3).any()


@pytest.mark.parametrize("unit", ["日本語文章", "приветмир", "the", "a", "ไทย", "中😀"])
def test_pieces_of_text_without_breaks(unit):
    data = np.frombuffer((unit * (500_000 // len(unit.encode()))).encode(), np.uint8)
    sampler, begun = pieces.Sampler(PIECES), time.process_time()
    ids, _ = sampler.encode(data, np.array([0, len(data)]), np.zeros(1, np.uint64))
    assert time.process_time() - begun < 10
    assert b"".join(sampler.vocabulary.spelling[i] for i in ids) == data.tobytes()


def test_pieces_of_rows(frame, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices("thing other ocean été 日本 <s> -- x".split(), k=i)))
            for i in range(60)] + [(100, None), (101, ""), (102, "▁ ▁"), (None, "no key")]
    rows += [(7, "again"), (7, "again")]
    docs = frame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    once = pieces.encoded(docs.repartition(2), PIECES, checked=True)
    assert all(r.lossless for r in once.collect())
    back = pieces.decoded(once, PIECES).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted(
        (str(d), t or "") for d, t in rows)
    assert all(r.n_pieces == len(r.ids) for r in back)
    again = pieces.encoded(docs.repartition(7), PIECES).collect()
    assert sorted((str(r.doc_id), r.ids) for r in again) == sorted(
        (str(r.doc_id), r.ids) for r in back)
    other = pieces.encoded(docs, PIECES, seed=1).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in other} != {(r.doc_id, tuple(r.ids)) for r in again}
    monkeypatch.setattr(pieces, "HELD_PARTS", 2)
    small = pieces.Sampler(PIECES)
    data, offsets = W.raw(pa.array([t or "" for _, t in rows[:60]]))
    ids, ends = small.encode(data, offsets, np.arange(60).astype(np.uint64))
    by = {r.doc_id: r.ids for r in again}
    for i in range(8, 60):
        assert ids[ends[i]:ends[i + 1]].tolist() == by[i]
    assert pieces.encoded(frame([]), PIECES).collect() == []


def test_vocabulary_has_no_reordering():
    """Every byte has a piece, so any text can be spelled."""
    vocabulary = pieces.sampler(PIECES).vocabulary
    assert (vocabulary.byte >= 0).all()
    assert json.dumps(sorted(vocabulary.by_length)) != "[]"
