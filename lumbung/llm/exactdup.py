"""Exact duplicates by an exchange of compressed fingerprints.

Each partition sorts the fingerprints of its texts, codes the gaps between them (Golomb-Rice) and
sends one short code to every owner of a range of fingerprints. An owner answers with one bitmap
per sender: which of these fingerprints occur elsewhere. Texts travel only where a bit is set, and
are compared byte by byte there. Texts that occur once never leave their partition.

Defined results: null text counts as empty; rows that repeat doc_id and text are members of their
group one by one, and only one of them is kept; a null doc_id is lower than every other; an empty
table gives no rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm.common import kept, likely, lowered, numbered, partitions, pick, restored

FINGERPRINT_BITS = 48  # 2^35 texts leave about one false suspect in 2^13 texts
CHUNK_ROWS = 1 << 19  # rows that one sender code covers at most

SENT = "owner int, sender long, n int, shift int, zeros binary, rest binary, rows binary"
REPLY = "owner int, sender long, bitmap binary"
FLAGGED = "doc_id long, digest binary, suspect boolean"
_ROW = np.dtype([("id", "<i8"), ("known", "u1"), ("new", "u1"), ("alone", "u1"),
                 ("digest", "u1", 32)])


def golomb_encode(values: np.ndarray, low: int, span: int) -> tuple[int, bytes, bytes]:
    """Ascending distinct values from ``low`` within ``span``: shift, unary part, low bits."""
    gaps = np.diff(values, prepend=np.uint64(low))
    shift = max(0, int(span / max(1, len(values)) * 0.69).bit_length() - 1)
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    low_bits = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return shift, np.packbits(unary).tobytes(), np.packbits(low_bits).tobytes()


def golomb_decode(n: int, low: int, shift: int, zeros: bytes, rest: bytes) -> np.ndarray:
    unary = np.unpackbits(np.frombuffer(zeros, np.uint8))
    ends = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    if shift:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * shift].reshape(n, shift)
        weights = np.uint64(1) << np.arange(shift - 1, -1, -1, dtype=np.uint64)
        gaps += (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _range_of(owner: int, owners: int) -> tuple[int, int]:
    """First fingerprint of an owner, and the size of its range."""
    whole = 1 << FINGERPRINT_BITS
    low = -(-whole * owner // owners)
    return low, -(-whole * (owner + 1) // owners) - low


def _chunk(ids: list[np.ndarray], known: list[np.ndarray], digests: list[np.ndarray], sender: int,
           owners: int) -> Iterator[tuple]:
    rows = np.zeros(sum(map(len, ids)), dtype=_ROW)
    rows["id"], rows["known"] = np.concatenate(ids), np.concatenate(known)
    rows["digest"] = np.concatenate(digests)
    prints = np.ascontiguousarray(rows["digest"][:, :8]).view(">u8")[:, 0].astype(np.uint64)
    prints >>= np.uint64(64 - FINGERPRINT_BITS)
    order = np.argsort(prints, kind="stable")
    rows, prints = rows[order], prints[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = prints[1:] != prints[:-1]
    rows["new"] = new
    starts = np.flatnonzero(new)
    rows["alone"] = np.repeat(np.diff(starts, append=len(rows)) == 1, np.diff(
        starts, append=len(rows)))
    lows = [_range_of(o, owners)[0] for o in range(owners)] + [1 << FINGERPRINT_BITS]
    cuts = np.searchsorted(prints, np.array(lows, dtype=np.uint64))
    for owner in range(owners):
        a, b = cuts[owner], cuts[owner + 1]
        if a == b:
            continue
        distinct = prints[a:b][new[a:b]]
        low, span = _range_of(owner, owners)
        shift, zeros, rest = golomb_encode(distinct, low, span)
        yield owner, sender, len(distinct), shift, zeros, rest, rows[a:b].tobytes()


def _sender(owners: int):
    """Codes for the owners, one for each chunk of a partition."""
    names = ["owner", "sender", "n", "shift", "zeros", "rest", "rows"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def packed(held, sender):
        rows = list(zip(*_chunk(*held, sender, owners), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, type=k) for x, k in zip(rows, kinds, strict=True)], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, size = TaskContext.get().partitionId() << 24, 0
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            held[0].append(ids.fill_null(0).to_numpy(zero_copy_only=False))
            held[1].append(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            digests = batch.column(1).combine_chunks() if isinstance(
                batch.column(1), pa.ChunkedArray) else batch.column(1)
            held[2].append(np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32))
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield packed(held, sender)
                sender, size, held = sender + 1, 0, ([], [], [])
        if size:
            yield packed(held, sender)

    return send


def _owner(owners: int):
    """A bitmap for each sender: fingerprints that another sender has as well."""

    def reply(sent: pa.Table) -> pa.Table:
        parts = [golomb_decode(n, _range_of(owner, owners)[0], shift, zeros, rest)
                 for owner, n, shift, zeros, rest in zip(*[
                     sent.column(c).to_pylist() for c in ("owner", "n", "shift", "zeros", "rest")],
                     strict=True)]
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        again = np.zeros(len(every), dtype=bool)
        same = ranked[1:] == ranked[:-1]
        again[order[1:]] |= same
        again[order[:-1]] |= same
        ends = np.cumsum([len(p) for p in parts])
        maps = [np.packbits(again[e - len(p):e]).tobytes() for e, p in zip(ends, parts,
                                                                           strict=True)]
        return pa.table({"owner": sent.column("owner"), "sender": sent.column("sender"),
                         "bitmap": pa.array(maps, pa.binary())})

    return reply


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sender's rows with the bits it got back; copies within the chunk count as well."""
    for batch in batches:
        for blob, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                strict=True):
            rows = np.frombuffer(blob, _ROW)
            bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))[np.cumsum(rows["new"]) - 1]
            digests = np.ascontiguousarray(rows["digest"]).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(rows["id"], pa.int64(), mask=rows["known"] == 0),
                pa.Array.from_buffers(pa.binary(), len(rows), [
                    None, pa.py_buffer((np.arange(len(rows) + 1) * 32).astype(np.int32).tobytes()),
                    pa.py_buffer(digests)]),
                pa.array((bits == 1) | (rows["alone"] == 0)),
            ], ["doc_id", "digest", "suspect"])


def suspects(digests: DataFrame, owners: int | None = None) -> DataFrame:
    """(doc_id, digest) with a flag: does another row have the same fingerprint."""
    owners = owners or partitions(digests.sparkSession)
    sent = kept(digests.select("doc_id", "digest").mapInArrow(_sender(owners), SENT))
    replies = sent.select("owner", "sender", "n", "shift", "zeros", "rest").groupBy(
        "owner").applyInArrow(_owner(owners), REPLY)
    return sent.select("owner", "sender", "rows").join(replies, ["owner", "sender"]).select(
        "rows", "bitmap").mapInArrow(_received, FLAGGED)


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def _print(digest):
    """The digest's first eight bytes, as the key of the prefilter."""
    return F.xxhash64(digest)


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest key stays.
    """
    docs = pick(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("text"))
    flagged = kept(suspects(docs.select("doc_id", _digest(F.col("text")).alias("digest")), owners))
    wanted = flagged.where("suspect").select(_print(F.col("digest")).alias("print"))
    near = likely(docs.withColumn("digest", _digest(F.col("text"))).withColumn(
        "print", _print(F.col("digest"))), "print", wanted, "maybe").where("maybe")
    groups = near.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"),
        F.min("text").alias("low"), F.max("text").alias("high")).where("group_size > 1")
    verified = groups.select(
        F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(F.raise_error(
            F.lit("different texts with one SHA-256 digest"))).alias("digest"),
        "group_size", "keep_id")
    members = flagged.where("suspect").groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
    copies = members.join(verified, "digest", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(
            F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "digest",
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    single = flagged.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        "digest", F.lit(1).cast("long").alias("copy"))
    return copies.unionByName(single).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; texts without copies are not shuffled."""
    verdict = kept(duplicate_groups(docs, key, text))
    stay = verdict.where("kept and group_size > 1").select(
        F.col("doc_id").alias("_stay"), F.unhex("text_sha256").alias("_digest"))
    copied = verdict.where("group_size > 1").select(_print(F.unhex("text_sha256")).alias("p"))
    rows, names = numbered(docs)
    rows = rows.withColumn("_digest", _digest(lowered(F.col(f"c{names.index(text)}"))))
    rows = likely(rows.withColumn("_print", _print(F.col("_digest"))), "_print",
                  copied.distinct(), "_maybe")
    digests = verdict.where("group_size > 1").select(
        F.unhex("text_sha256").alias("_digest")).distinct()
    maybe = rows.where("_maybe")
    place = F.col(f"c{names.index(key)}").cast("long")
    chosen = maybe.join(stay, (maybe["_digest"] == stay["_digest"]) & place.eqNullSafe(
        F.col("_stay")), "left_semi").dropDuplicates(["_digest"])
    alone = maybe.join(digests, "_digest", "left_anti")
    return restored(rows.where("not _maybe").unionByName(chosen).unionByName(
        alone.select(*rows.columns)), names)
