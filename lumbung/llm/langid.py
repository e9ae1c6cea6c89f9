"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes of its lower-case letters, other ASCII as
blanks), weighted log(1 + count) * idf and normalised. Document frequencies cover all training
rows. Each language has a few centroids from spherical k-means on a bounded sample; a text takes
the language of the nearest centroid by cosine, and is rejected when it is farther from it than
nearly all of that language's sample.

Defined results: null text, or text without a letter, is ``und`` with score 0; with no training row
every text is; ties go to the language that sorts first; repeated rows are predicted one by one;
an empty table gives no rows. The language column is read for training rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import numbered, pick, restored, small

DIMS = 4096
SAMPLE = 1500  # training documents per language that the centroids are fitted on, at most
CLUSTERS = 4
ROUNDS = 12
REJECT_RANK, REJECT_SHARE = 0.01, 0.5  # rejected below half of the sample's lowest per cent
UNDETERMINED = "und"
PART_ROWS, PART_BYTES = 512, 1 << 20  # texts that are counted at once

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    """Centroids by language; small enough to travel with the tasks."""

    idf: np.ndarray
    languages: list[str]  # one per centroid, sorted
    centroids: np.ndarray
    limits: np.ndarray  # least accepted cosine, one per centroid


def counts(column: pa.Array) -> np.ndarray:
    """Hashed n-gram counts (texts x DIMS) of lower-case texts."""
    data, offsets = W.raw(column)
    n = len(offsets) - 1
    data = _LETTER[data]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    blank = data == 32
    gram = np.zeros(len(data), np.uint32)
    out = np.zeros(n * DIMS, np.int64)
    for size in range(1, 4):
        m = len(data) - size + 1
        if m < 1:
            break
        gram = (gram[:m] << np.uint32(8)) | data[size - 1:]
        if size == 1:
            use = ~blank
        else:  # within one text, and no two blanks side by side
            use = (use[:m] if size == 3 else np.ones(m, bool)) & (row[:m] == row[size - 1:])
            use &= ~(blank[size - 2:size - 2 + m] & blank[size - 1:])
        bucket = ((gram[use] + np.uint32(size << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount(row[:m][use].astype(np.int64) * DIMS + bucket, minlength=n * DIMS)
    return out.reshape(n, DIMS)


def vectors(held: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(held.astype(np.float32)) * idf
    length = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
    return weighted / np.maximum(length, 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, texts that have it) of a partition; dim -1 counts the texts."""
    total, texts = np.zeros(DIMS, np.int64), 0
    for whole in batches:
        for batch in W.slices(whole, "text", PART_BYTES, PART_ROWS):
            total += (counts(batch.column("text")) > 0).sum(axis=0)
            texts += batch.num_rows
    yield pa.RecordBatch.from_arrays([
        pa.array(np.arange(-1, DIMS), pa.int64()), pa.array([texts, *total], pa.int64())],
        ["dim", "n"])


def cluster(points: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means from farthest-first starts; no chance involved."""
    centre = points.mean(axis=0)
    chosen = [int((points @ centre).argmax())]
    while len(chosen) < min(k, len(points)):
        chosen.append(int((points @ points[chosen].T).max(axis=1).argmin()))
    centroids = points[chosen]
    for _ in range(ROUNDS):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.stack([points[nearest == c].sum(axis=0) if (nearest == c).any() else centroids[c]
                         for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _fitted(idf: np.ndarray):
    """Centroids of one language's bounded sample."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        parts = [vectors(counts(b.column("text")), idf).astype(np.float32)
                 for whole in table.combine_chunks().to_batches()
                 for b in W.slices(whole, "text", PART_BYTES, PART_ROWS)]
        points = np.concatenate(parts)
        centroids = cluster(points)
        cosine = (points @ centroids.T).max(axis=1)
        limit = float(np.quantile(cosine, REJECT_RANK)) * REJECT_SHARE
        n = len(centroids)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * n, pa.string()),
                         "limit": pa.array([limit] * n, pa.float64()),
                         "centroid": pa.array([c.astype("<f4").tobytes() for c in centroids],
                                              pa.binary())})

    return fit


def train(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, lang, text) with a language and a text."""
    rows = labelled.select("doc_id", "lang", F.lower("text").alias("text"))
    seen = rows.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(
        F.sum("n").alias("n")).collect()  # one row per dimension
    found = np.zeros(DIMS + 1, np.float64)
    for dim, n in seen:
        found[dim + 1] = n
    idf = (np.log((1 + found[0]) / (1 + found[1:])) + 1).astype(np.float32)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("id_lang"))
    sample = rows.join(small(ids.distinct()), (F.col("doc_id") == F.col("id")) & (
        F.col("lang") == F.col("id_lang")), "left_semi")
    fitted = sample.groupBy("lang").applyInArrow(
        _fitted(idf), "lang string, limit double, centroid binary").collect()
    fitted = sorted(fitted, key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model(idf, [r["lang"] for r in fitted],
                 np.array([np.frombuffer(r["centroid"], "<f4") for r in fitted]).reshape(-1, DIMS),
                 np.array([r["limit"] for r in fitted]))


def predict(model: Model, column: pa.Array, lettered: np.ndarray
            ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of lower-case texts."""
    n = len(column)
    if len(model.languages) == 0 or n == 0:
        return [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
    cosine = vectors(counts(column), model.idf) @ model.centroids.T
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1)
    langs = [model.languages[b] if ok else UNDETERMINED
             for b, ok in zip(best, lettered, strict=True)]
    return langs, np.where(lettered, score, 0.0), ~lettered | (score < model.limits[best])


def _verdicts(model: Model):
    """An Arrow function of (lower-case text, has a letter); other columns stay with Spark."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def verdict(lowered: pa.Array, lettered: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([lowered, lettered], ["lowered", "lettered"])
        parts: list[tuple] = [([], np.zeros(0), np.zeros(0, bool))]
        for batch in W.slices(rows, "lowered", PART_BYTES, PART_ROWS):
            parts.append(predict(model, batch.column(0), batch.column(1).to_numpy(
                zero_copy_only=False)))
        langs, scores, rejected = zip(*parts, strict=True)
        return pa.StructArray.from_arrays([
            pa.array([x for part in langs for x in part], pa.string()),
            pa.array(np.concatenate(scores), pa.float64()),
            pa.array(np.concatenate(rejected), pa.bool_())], ["lang_pred", "score", "rejected"])

    return verdict


def with_language(rows: DataFrame, text: Column, model: Model) -> DataFrame:
    """``rows`` with lang_pred, score and rejected."""
    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    judged = rows.withColumn("_language", _verdicts(model)(F.lower(text), lettered))
    return judged.select(*rows.columns, "_language.*")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
                  ) -> DataFrame:
    rows = pick(docs, doc_id=key, text=text, lang=lang)
    return rows.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull())


def language_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
                 ) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    model = train(training_rows(docs, key, text, lang))
    rows = pick(docs, doc_id=key, text=text)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return with_language(rows.select("doc_id", held_out.alias("held_out"), "text"), F.col("text"),
                         model).drop("text")


def in_known_language(docs: DataFrame, key: str = "doc_id", text: str = "text",
                      lang: str = "lang") -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    model = train(training_rows(docs, key, text, lang))
    rows, names = numbered(docs)
    return restored(with_language(rows, F.col(f"c{names.index(text)}"), model).where(
        "not rejected"), names)
