"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

Tokens fall into buckets: the end token, the most frequent words one by one, and all other words by
a hash of their last two bytes. The model predicts the next bucket from the two before it: the
context's vectors, each through a matrix of its place, add up to a predicted vector, whose product
with a bucket's vector plus its bias is the score. Scoring normalises exactly over all buckets; a
word's share of its bucket is its add-one frequency there, with one place for unseen words. So
the probabilities of all words, and the unseen one, sum to one.

What is learned from the corpus, all of it: word counts, and how often each bucket follows each
context. Training runs on those counts where they lie: a hash deals them to a fixed number of
parts, which train from common parameters, and the weighted mean starts the next round. So equal
documents give an equal model in any partitioning, and again after a lost executor. Only parameters (a fixed size) and the most
frequent words (a fixed number) travel through the driver; counts of other words are joined.

Defined results: null text is empty and has the end token only; repeated rows are scored one by
one; rows without doc_id are training rows; with no training rows every score is that of the
untrained model; an empty table gives no rows. Columns other than the key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import kept, pick

FOLDS, HELD_OUT = 7, 2
FREQUENT = 383  # words with a bucket of their own
ENDINGS = 128  # buckets of the other words
BUCKETS = 1 + FREQUENT + ENDINGS
SENT_WORDS = 1 << 17  # most frequent words whose counts are sent to every task (2 MB)
DIM = 32
ROUNDS = 5
TRAINING_PARTS = 16  # trained side by side; there are at most BUCKETS**3 counts at any size
NOISE = 64
MINIBATCH = 4096
HEAVY = 4096
RATE = 0.1
SEED = 11
MERGE_AT = 1 << 22  # distinct entries that a task gathers before it sends them on
END_HASH = np.uint64(1)

_SHAPES = {"context": (BUCKETS, DIM), "target": (BUCKETS, DIM), "places": (2, DIM, DIM),
           "bias": (BUCKETS,)}


# -- tokens ---------------------------------------------------------------------------------------

def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, ending class and row of every token; each text ends with the end token."""
    data, offsets = W.raw(column)
    n = len(offsets) - 1
    starts, ends, rows = W.find(data, offsets)
    folded = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint8)
    last = folded[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, folded[ends - 2], 0).astype(np.uint64)
    ending = (W.mix((before << np.uint64(8)) | last) % np.uint64(ENDINGS)).astype(np.int64)
    counts = np.bincount(rows, minlength=n)
    place = np.arange(len(rows)) + rows  # one end token for each text before
    hashes = np.full(len(rows) + n, END_HASH, np.uint64)
    endings = np.zeros(len(rows) + n, np.int64)
    hashes[place], endings[place] = W.hashes(data, starts, ends), ending
    return hashes, endings, np.repeat(np.arange(n), counts + 1)


class Gathered:
    """Sums of counts by key, sent on in parts."""

    def __init__(self):
        self.keys, self.more, self.size = [], [], 0

    def add(self, keys: np.ndarray, more: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append((keys, counts))
        self.more.append(more)
        self.size += len(keys)

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.keys])
        counts = np.concatenate([c for _, c in self.keys])
        more = np.concatenate(self.more)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        self.__init__()
        return distinct, more[first], total


def _gather(of_batch, names: list[str]):
    """Streams (key, more, count) of a partition, summed as far as memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, merged = Gathered(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64), pa.int64()) for x in held.taken()], names)

        for whole in batches:
            for batch in W.slices(whole, "text"):
                held.add(*of_batch(batch.column("text")))
                if held.size >= max(MERGE_AT, 2 * merged):
                    keys, more, counts = held.taken()
                    if len(keys) >= MERGE_AT:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x.astype(np.int64), pa.int64()) for x in (keys, more, counts)
                             ], names)
                    else:
                        held.add(keys, more, counts)
                        merged = len(keys)
        yield out()

    return run


def _word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, endings, _ = tokens(column)
    distinct, first, counts = np.unique(hashes.view(np.int64), return_index=True,
                                        return_counts=True)
    return distinct, endings[first], counts


# -- the model ------------------------------------------------------------------------------------

@dataclass
class Buckets:
    """The frequent words and the totals of the other words by ending."""

    words: np.ndarray  # hashes of the frequent words, ascending; bucket i + 1
    log_total: np.ndarray  # log10(count + kinds + 1) of each ending
    noise: np.ndarray  # share of each bucket in the training tokens

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + FREQUENT + endings
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[at] == hashes, 1 + at, out)
        return np.where(hashes == END_HASH, 0, out)


def contexts(buckets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Context number of each token: the two buckets before it, the end token before a text."""
    first = np.zeros(len(buckets), np.int64)
    second = np.zeros(len(buckets), np.int64)
    first[1:] = np.where(rows[1:] == rows[:-1], buckets[:-1], 0)
    second[2:] = np.where(rows[2:] == rows[:-2], buckets[:-2], 0)
    return second * BUCKETS + first


def _follow_counts(buckets: Buckets):
    def count(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, endings, rows = tokens(column)
        own = buckets.of(hashes, endings)
        keys, counts = np.unique(contexts(own, rows) * BUCKETS + own, return_counts=True)
        return keys, np.zeros(len(keys), np.int64), counts

    return count


def untrained(noise: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    out = {n: rng.normal(0, 0.1, s).astype(np.float32) for n, s in _SHAPES.items()}
    out["places"] = (out["places"] + np.eye(DIM, dtype=np.float32) * 0.5).astype(np.float32)
    out["bias"] = np.log(np.maximum(noise, 1e-9)).astype(np.float32)
    return out


def packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[n].astype("<f4").tobytes() for n in _SHAPES)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape).copy()
        at += size
    return out


def predicted(model: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    """The vector expected after each context."""
    return model["context"][context % BUCKETS] @ model["places"][0] + model["context"][
        context // BUCKETS] @ model["places"][1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def whole_pass(counts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows in random order and their weights; a row's weights are in proportion to its count.

    A row above a ``HEAVY``-th of a minibatch's usual sum comes in equal parts, so that no single
    count rules a step. The parts add at most ``HEAVY`` rows to a minibatch.
    """
    usual = counts.sum() * min(1.0, MINIBATCH / len(counts))
    times = np.ceil(counts * (HEAVY / usual)).astype(np.int64)
    row = rng.permutation(np.repeat(np.arange(len(counts)), times))
    return row, (counts[row] / (times[row] * usual)).astype(np.float32)


def train_locally(model: dict[str, np.ndarray], noise: np.ndarray, keys: np.ndarray,
                  counts: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation over (context, bucket) counts, with Adagrad.

    One full pass: every count is used, its gradient weighted by it. ``NOISE`` buckets drawn from
    the noise distribution are shared by the counts of a minibatch.
    """
    rng = np.random.default_rng([SEED, seed])
    model = {n: v.copy() for n, v in model.items()}
    speed = {n: np.full(v.shape, 1e-4, np.float32) for n, v in model.items()}
    log_noise = np.log(np.maximum(noise, 1e-9) * NOISE).astype(np.float32)
    edges = np.cumsum(noise)

    def step(name: str, gradient: np.ndarray) -> None:
        speed[name] += gradient * gradient
        model[name] += RATE * gradient / np.sqrt(speed[name])

    row, weights = whole_pass(counts, rng)
    for at in range(0, len(row), MINIBATCH):
        part, weight = row[at:at + MINIBATCH], weights[at:at + MINIBATCH]
        word, context = keys[part] % BUCKETS, keys[part] // BUCKETS
        one, two = context % BUCKETS, context // BUCKETS
        vector = predicted(model, context)
        drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE) * edges[-1]), BUCKETS - 1)
        good = (vector * model["target"][word]).sum(axis=1) + model["bias"][word] - log_noise[word]
        bad = vector @ model["target"][drawn].T + model["bias"][drawn] - log_noise[drawn]
        up = (1 - _sigmoid(good)) * weight
        down = -_sigmoid(bad) * weight[:, None]
        to_vector = up[:, None] * model["target"][word] + down @ model["target"][drawn]
        target, bias = np.zeros(_SHAPES["target"], np.float32), np.zeros(BUCKETS, np.float32)
        np.add.at(target, word, up[:, None] * vector)
        np.add.at(target, drawn, down.T @ vector)
        np.add.at(bias, word, up)
        np.add.at(bias, drawn, down.sum(axis=0))
        place = np.stack([model["context"][one].T @ to_vector, model["context"][two].T @ to_vector])
        source = np.zeros(_SHAPES["context"], np.float32)
        np.add.at(source, one, to_vector @ model["places"][0].T)
        np.add.at(source, two, to_vector @ model["places"][1].T)
        for name, gradient in (("target", target), ("bias", bias), ("places", place),
                               ("context", source)):
            step(name, gradient)
    return model


def _trained(model: bytes, noise: np.ndarray, number: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            keys = np.concatenate([k for k, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            order = np.argsort(keys)  # rows come in any order
            part = TaskContext.get().partitionId()
            out = train_locally(unpacked(model), noise, keys[order], counts[order],
                                number * 1_000_003 + part)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([float(counts.sum())]),
                pa.array([packed(out)], pa.binary())], ["part", "weight", "model"])

    return train


def training_parts(follows: DataFrame) -> DataFrame:
    """Sums of (key, n), stored in ``TRAINING_PARTS`` partitions that a hash of the key chooses.

    A key's partition does not depend on the partitions it came from, nor on a lost executor.
    """
    return kept(follows.repartition(TRAINING_PARTS, "key").groupBy("key").agg(
        F.sum("n").alias("n")))


def train(follows: DataFrame, noise: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters from ``training_parts``; the driver sees one model per part and round."""
    model = untrained(noise)
    for number in range(rounds):
        parts = follows.mapInArrow(_trained(packed(model), noise, number),
                                   "part int, weight double, model binary").collect()
        total = sum(r["weight"] for r in parts)
        if not total:
            break
        mean = sum(r["weight"] / total * np.frombuffer(bytes(r["model"]), "<f4").astype(np.float64)
                   for r in sorted(parts, key=lambda r: r["part"]))
        model = unpacked(mean.astype("<f4").tobytes())
    return model


# -- scoring --------------------------------------------------------------------------------------

class Scorer:
    """Normalised log10 probabilities; each context's normaliser is computed once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.normal = np.full(BUCKETS * BUCKETS, np.nan, np.float64)

    def normalise(self, context: np.ndarray) -> None:
        new = np.unique(context)
        new = new[np.isnan(self.normal[new])]
        for at in range(0, len(new), MINIBATCH):
            part = new[at:at + MINIBATCH]
            logits = predicted(self.model, part) @ self.model["target"].T + self.model["bias"]
            top = logits.max(axis=1)
            self.normal[part] = top + np.log(np.exp(logits - top[:, None]).sum(
                axis=1, dtype=np.float64))

    def log10(self, context: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        self.normalise(context)
        distinct, which = np.unique(context * BUCKETS + bucket, return_inverse=True)
        word, before = distinct % BUCKETS, distinct // BUCKETS
        logit = (predicted(self.model, before) * self.model["target"][word]).sum(
            axis=1) + self.model["bias"][word]
        return ((logit - self.normal[before]) / np.log(10))[which]


SCORED = ("doc_id long, held_out boolean, uid long, n_tokens long, n_known long, common double, "
          "own double, words array<long>, times array<long>")


def _scored(model: dict[str, np.ndarray], buckets: Buckets, sent: np.ndarray, counts: np.ndarray):
    """Scores that need the frequent words only, and the other words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, uid = Scorer(model), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in W.slices(whole, "text"):
                hashes, endings, rows = tokens(batch.column("text"))
                n = batch.num_rows
                own = buckets.of(hashes, endings)
                value = scorer.log10(contexts(own, rows), own)
                other = own > FREQUENT
                value[other] -= buckets.log_total[own[other] - 1 - FREQUENT]
                at = np.minimum(np.searchsorted(sent, hashes), max(0, len(sent) - 1))
                known = sent[at] == hashes if len(sent) else np.zeros(len(hashes), bool)
                share = np.where(known, np.log10((counts[at] if len(sent) else np.zeros(
                    len(hashes))) + 1), 0.0)
                rest = np.flatnonzero(~known)
                order = rest[np.lexsort((hashes[rest], rows[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (
                    rows[order][1:] != rows[order][:-1])
                begin = np.flatnonzero(new)
                times = np.diff(begin, append=len(order))
                ends = np.searchsorted(rows[order][begin], np.arange(n + 1)).astype(np.int32)
                words = hashes[order][begin].view(np.int64)

                def summed(x: np.ndarray, rows=rows, n=n) -> pa.Array:
                    return pa.array(np.bincount(rows, weights=x, minlength=n))

                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array(uid + np.arange(n), pa.int64()),
                    pa.array(np.bincount(rows, minlength=n), pa.int64()),
                    pa.array(np.bincount(rows, weights=known, minlength=n).astype(np.int64)),
                    summed(share), summed(value + np.where(other, share, 0.0)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(words)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64)))],
                    [c.split()[0] for c in SCORED.split(", ")])
                uid += n

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = pick(docs, doc_id=key, text=text)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
                          == HELD_OUT, F.lit(False))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                       "text")
    learn = rows.where("not held_out").select("text")
    counts = kept(learn.mapInArrow(_gather(_word_counts, ["word", "ending", "n"]),
                                   "word long, ending long, n long").groupBy("word").agg(
        F.min("ending").alias("ending"), F.sum("n").alias("n")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "word").limit(SENT_WORDS).toArrow()
    word = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    many = top.column("n").to_numpy().astype(np.int64)
    frequent = np.sort(word[word != END_HASH][:FREQUENT])
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")
                                             ).collect()  # one row per ending
    n_of, kinds_of = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        n_of[r["ending"]], kinds_of[r["ending"]] = r["n"], r["kinds"]
    alone = np.isin(word, frequent) | (word == END_HASH)
    ending_of = top.column("ending").to_numpy()
    np.subtract.at(n_of, ending_of[alone], many[alone])
    np.subtract.at(kinds_of, ending_of[alone], 1)
    share = np.zeros(BUCKETS)
    share[1 + FREQUENT:] = n_of
    order = np.argsort(word)
    share[0] = many[word == END_HASH].sum()
    share[1:1 + len(frequent)] = many[order][np.searchsorted(word[order], frequent)]
    share = (share + 1) / (share + 1).sum()
    buckets = Buckets(frequent, np.log10(n_of + kinds_of + 1), share)
    follows = training_parts(learn.mapInArrow(
        _gather(_follow_counts(buckets), ["key", "none", "n"]), "key long, none long, n long"))
    model = train(follows, share)
    scored = kept(rows.mapInArrow(_scored(model, buckets, word[order], many[order]), SCORED))
    spread = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = spread.join(counts.select("word", "n"), "word").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"),
        F.sum("times").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("words", "times").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("common") + more - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias(
            "base_score"),
        (F.col("own") + more).alias("score"))
