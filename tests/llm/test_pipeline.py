"""The pipeline against a plain restatement of its stages."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from lumbung.llm import langid, packing
from tests.llm import brute
from tests.llm.test_text import verdicts

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]

    model = langid.train(langid.training_rows(docs))
    lettered = np.array([any(c.isalpha() for c in t or "") for _, t, _, _ in rows])
    rejected = langid.predict(model, pa.array([(t or "").lower() for _, t, _, _ in rows]),
                              lettered)[2]
    rows = [r for r, gone in zip(rows, rejected, strict=True) if not gone]
    good = verdicts(rows)
    rows = [r for r in rows if good[r[0]][0]]
    stay = {d for d, keep, _, _ in brute.copies([(r[0], r[1]) for r in rows]) if d == keep}
    rows = [r for r in rows if r[0] in stay]
    component, _ = brute.near([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if component[r[0]] == r[0]]
    tokenizer = packing.encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = []
    for d, t, _, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start:start + 4096], "<u4")
            want.append((d, piece, start, len(part), zlib.crc32(part.tobytes())))

    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_rules", "exact_dedup", "near_dedup", "best_fit_packing"]


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).schema == docs.schema
