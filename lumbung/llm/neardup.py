"""Near duplicates: banded MinHash, sequential Bayesian pruning, exact verification.

Texts with equal shingle sets form a class, and only classes are compared. Classes that share a
band of their signature are candidates. A candidate's signatures are compared batch by batch; after
each batch, a pair is dropped when the posterior probability that its similarity reaches the
threshold falls below the chosen miss probability. Survivors are confirmed on their full shingle
sets, built from the texts.

Work inside large buckets stays small. First every member meets only the hub of its bucket, the
member that shares buckets with most others. Members whose component is then known to be the same
need not be compared; what is left of a bucket is compared in tiles of bounded size. Tiles first
hold signatures only and name the members that have a plausible partner in them; a pair belongs to
the first bucket it shares. Only these members come again with their sets, and links are confirmed
inside the tile. So no list of pairs ever leaves a tile, and most sets never enter one.

Sets are kept as 64-bit hashes of their shingles; two different shingles of one pair of texts agree
with probability below 1e-10 even for the longest texts.

Signatures keep 16 bits of each minimum: equal ones stay equal, and others agree by chance too
rarely to matter, for a value (1 in 65,536) as for a band (1 in 2^64).

With 32 bands of 4 rows a pair of similarity 0.8 shares no band with probability 5e-8.

Defined results: null text or text without words has an empty set and is linked with nothing; fewer
words than a shingle's width make one shingle; repeated rows each get a row; rows that share a
doc_id but not the text are each judged by their text; rows without doc_id are linked by their text,
and a component that has no doc_id at all has a null one; an empty table gives no rows. Columns
other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.llm import words as W
from lumbung.llm.common import likely, numbered, partitions, pick, restored, small, written
from lumbung.llm.components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16  # signature values that one look compares
MISS = 1e-7  # chosen probability, at each look, to drop a pair that reaches the threshold
SEED = 7
MINOR_BLOCK, MEMBER_BLOCK = 256, 1024  # sides of a tile

PROFILE = "doc_id long, n_shingles long, digest binary, signature binary"
SETS = "digest binary, shingles binary"
PAIRS = "a long, b long"
PLAUSIBLE = "bucket long, i int, j int, cid long"

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


# -- sets and signatures --------------------------------------------------------------------------

def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    starts, ends, rows = W.find(data, offsets)
    words = W.hashes(data, starts, ends)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    edges = np.concatenate([[0], np.cumsum(counts)])

    def joined(n: int) -> np.ndarray:
        """A hash of each run of n words, wherever it starts."""
        held = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            held = W.mix(held ^ words[i:len(words) - n + 1 + i])
        return held

    whole = {n: joined(n) for n in range(1, width + 1)} if len(words) else {}
    out = []
    for row, n in enumerate(counts.tolist()):
        take = min(n, width)
        at = edges[row]
        out.append(np.unique(whole[take][at:at + n - take + 1]) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x hashes, 16 bits each) of non-empty sets."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            mixed = every * _FACTORS[k] + _SHIFTS[k]
            least = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
            out[:, k] = least & np.uint32(0xFFFF)
    return out


def _set_digest(one: np.ndarray) -> bytes | None:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None


def _profiles(width: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = shingle_sets(*W.raw(batch.column("text")), width)
                full = [s for s in sets if len(s)]
                marks = iter(signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_digest(s) for s in sets], pa.binary()),
                    pa.array([next(marks).tobytes() if len(s) else None for s in sets],
                             pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return profile


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                found = shingle_sets(*W.raw(batch.column("text")), width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(map(_set_digest, found)), pa.binary()),
                    pa.array([x.tobytes() for x in found], pa.binary())], ["digest", "shingles"])

    return sets


# -- pruning and verification ---------------------------------------------------------------------

@lru_cache
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the matches below which a pair is dropped.

    With a uniform prior, P(similarity >= t | m of n match) is the probability of at most m
    successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the rows whose signatures stay plausible batch after batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches(percent)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches += (left[alive, part] == right[alive, part]).sum(axis=1)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return W.raw(column)[0].view(np.uint16).reshape(-1, HASHES)


def _pruned(percent: int):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(survivors(_matrix(batch.column(2)), _matrix(batch.column(3)),
                                        percent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return prune


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the non-empty sorted sets reach the threshold with ``one``."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(one) + sizes - common)


def _shingles(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _confirmed(percent: int):
    """Pairs whose full shingle sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [bool(linked(_shingles(x), [_shingles(y)], percent)[0]) for x, y in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(ok, pa.bool_())) for i in range(2)], ["a", "b"])

    return confirm


def _partners(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each minor member of a tile with its plausible partners in other components."""
    minor, full = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
    band = int(rows["band"][0])
    for x in minor:
        mark = rows["signature"][x]
        ok = full[(rows["root"][full] != rows["root"][x]) & (rows["cid"][full] != rows["cid"][x])]
        ok = ok[survivors(np.broadcast_to(mark, (len(ok), HASHES)), rows["signature"][ok],
                          percent)]
        if len(ok):
            same = (rows["signature"][ok] == mark).reshape(len(ok), BANDS, -1).all(axis=2)
            ok = ok[same.argmax(axis=1) == band]  # elsewhere the pair met in an earlier band
        if len(ok):
            yield int(x), ok


def _plausible(percent: int):
    def named(rows: dict[str, np.ndarray], _: list) -> list[tuple]:
        """(tile, cid) of every member that has a partner in the tile."""
        met: set[int] = set()
        for x, others in _partners(rows, percent):
            met.update((int(rows["cid"][x]), *rows["cid"][others].tolist()))
        return [(*(int(rows[n][0]) for n in ("bucket", "i", "j")), cid) for cid in met]

    return _by_tile(named, PLAUSIBLE)


def _links(percent: int):
    def confirmed(rows: dict[str, np.ndarray], shingles: list[bytes]) -> list[tuple]:
        """Links of the tile, confirmed on full sets."""
        out: list[tuple] = []
        for x, others in _partners(rows, percent):
            ok = others[linked(_shingles(shingles[x]), [_shingles(shingles[y]) for y in others],
                               percent)]
            own = int(rows["cid"][x])
            out.extend((max(own, int(y)), min(own, int(y))) for y in rows["cid"][ok])
        return out

    return _by_tile(confirmed, PAIRS)


def _by_tile(work, schema: str):
    """Goes through rows sorted by tile; a tile is held only while its rows arrive."""
    names = ["bucket", "i", "j", "band", "side", "cid", "root"]
    columns = [(x.split()[0], {"long": pa.int64(), "int": pa.int32()}[x.split()[1]])
               for x in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(table: pa.Table, final: bool) -> tuple[list[tuple], pa.Table | None]:
            held = {n: table.column(n).to_numpy() for n in names}
            held["signature"] = _matrix(table.column("signature"))
            sets = "shingles" in table.column_names
            same = np.ones(len(table), bool)
            same[0] = False
            for n in ("bucket", "i", "j"):
                same[1:] &= held[n][1:] == held[n][:-1]
            edges = [*np.flatnonzero(~same).tolist(), len(table)]
            stop = len(edges) - 1 if final else len(edges) - 2
            out: list[tuple] = []
            for a, b in zip(edges[:stop], edges[1:stop + 1], strict=True):
                out += work({n: v[a:b] for n, v in held.items()}, table.column("shingles").slice(
                    a, b - a).to_pylist() if sets else [])
            return out, None if final else table.slice(edges[-2])

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, (
                _, kind) in enumerate(columns)], [name for name, _ in columns])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            out, rest = cut(table, False)
            yield packed(out)
        if rest is not None and len(rest):
            yield packed(cut(rest, True)[0])

    return compare


# -- the operator ---------------------------------------------------------------------------------

def _prune_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that stay after comparing signatures."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    marks = likely(classes.select("cid", "signature"), "cid", ids, "met").where("met")
    return pairs.join(marks.select(F.col("cid").alias("a"), F.col("signature").alias("x")),
                      "a").join(
        marks.select(F.col("cid").alias("b"), F.col("signature").alias("y")), "b").select(
        "a", "b", "x", "y").mapInArrow(_pruned(percent), PAIRS)


def _confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs confirmed on their full sets."""
    return pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a"
                      ).join(
        sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b").select(
        "a", "b", "x", "y").mapInArrow(_confirmed(percent), PAIRS).distinct()


def _met_sets(members: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Shingle sets of classes that share a bucket; other texts are read but not moved."""
    met = written(classes.select("cid", "digest", "name").join(
        members.select("cid").distinct(), "cid", "left_semi"))
    ids = met.where("name is not null").select("name").distinct()
    near = likely(docs, "doc_id", ids, "met").where("met or doc_id is null").select("text")
    return near.mapInArrow(_sets(width), SETS).groupBy("digest").agg(
        F.any_value("shingles").alias("shingles")).join(
        met.select("cid", "digest"), "digest").select("cid", "shingles")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, band, cid, hub) of every class in a bucket that it shares."""
    bands = F.array(*[F.xxhash64(F.substring("signature", 1 + 2 * ROWS * b, 2 * ROWS), F.lit(b))
                      for b in range(BANDS)])
    banded = classes.select("cid", F.posexplode(bands).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(banded.join(sizes, "bucket"))
    weights = shared.groupBy("cid").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weights, "cid").groupBy("bucket").agg(F.max_by(
        "cid", F.struct("weight", -F.col("cid"))).alias("hub"))
    return shared.drop("n").join(hubs, "bucket")


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, i, j, band, side, cid): tiles of buckets that hold several components.

    The hub has met all others. Members outside a bucket's largest component (side 0) meet all of
    its members (side 1).
    """
    rooted = _rooted(members.where("cid <> hub").select("bucket", "band", "cid"), labels)
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members"),
        F.count("*").alias("roots"), F.max("n").alias("largest")).where("roots > 1")
    wide = F.ceil(F.col("members") / MEMBER_BLOCK).cast("int")
    high = F.ceil((F.col("members") - F.col("largest")) / MINOR_BLOCK).cast("int")
    met = rooted.join(mixed.select("bucket", "main", wide.alias("wide"), high.alias("high")),
                      "bucket")
    own = F.col("cid")
    member = met.select("bucket", "band", "cid", F.lit(1).alias("side"), F.explode(
        F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(
        F.xxhash64(own), "wide").cast("int").alias("j"))
    minor = met.where("root <> main").select(
        "bucket", "band", "cid", F.lit(0).alias("side"), F.pmod(
            F.xxhash64(own), "high").cast("int").alias("i"), F.explode(F.sequence(
                F.lit(0), F.col("wide") - 1)).alias("j"))
    return member.unionByName(minor)


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of ``cid``, as column root."""
    return rows.join(labels.select(F.col("node").alias("cid"), F.col("component").alias("root")),
                     "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links, which are few: only the components that they touch change."""
    def root(df: DataFrame, node: str) -> DataFrame:
        own = labels.select(F.col("node").alias(node), F.col("component").alias(f"{node}_root"))
        return df.join(own, node, "left").withColumn(f"{node}_root", F.coalesce(
            f"{node}_root", node))

    between = root(root(links, "a"), "b").where("a_root <> b_root").select(
        F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b"))
    moved = written(components(between))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(labels.join(to, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")).unionByName(
        moved.join(labels, "node", "left_anti")))


def _left_over(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame,
               percent: int) -> DataFrame:
    """Labels after links inside buckets whose members, besides the hub, lie in several components.
    """
    place = ["bucket", "i", "j"]
    marks = classes.select("cid", "signature")
    rows = _rooted(_placed(members, labels), labels).select(*place, "band", "side", "cid", "root")

    def dealt(tiles: DataFrame) -> DataFrame:
        return tiles.repartition(partitions(members.sparkSession), *place).sortWithinPartitions(
            *place)

    near = written(dealt(rows.join(marks, "cid")).mapInArrow(_plausible(percent), PLAUSIBLE
                                                          ).distinct())
    full = rows.join(small(near), [*place, "cid"], "left_semi").join(
        sets.join(marks, "cid"), "cid")
    links = written(dealt(full).mapInArrow(_links(percent), PAIRS).distinct())
    return labels if links.isEmpty() else _merged(labels, links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of distinct
    ``width``-word shingles; a component is named by its smallest doc_id, whose row stays.
    """
    docs = pick(docs, doc_id=key, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(docs.mapInArrow(_profiles(width), PROFILE))
    classes = written(profiles.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("name"), F.any_value("signature").alias("signature")).withColumn(
        "cid", F.monotonically_increasing_id()))
    members = written(_members(classes))
    sets = written(_met_sets(members, docs, classes, width))
    spokes = members.where("cid <> hub").select(
        F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct()
    first = _confirm_pairs(_prune_pairs(spokes, classes, percent), sets, percent)
    labels = _left_over(members, written(components(first)), classes, sets, percent)
    nodes = labels.withColumnRenamed("node", "cid")
    linked_classes = classes.select("cid", "name", "digest").join(nodes, "cid")
    names = written(linked_classes.groupBy("component").agg(F.min("name").alias("smallest")))
    by_class = written(linked_classes.join(small(names), "component").select(
        "digest", F.col("smallest").alias("component_id")).unionByName(
        classes.join(nodes, "cid", "left_anti").select(
            "digest", F.col("name").alias("component_id"))))
    rows = profiles.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    named = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias(
        "component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                        percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest doc_id of a component.

    Rows without doc_id cannot be told apart by it and stay. Only rows that may have to go are
    shuffled.
    """
    verdict = near_duplicates(docs, key, text, width, percent)
    gone = written(verdict.where("doc_id is not null and not kept").select(
        F.col("doc_id").alias("_gone")).distinct())
    rows, names = numbered(docs)
    place = f"c{names.index(key)}"
    rows = likely(rows.withColumn("_key", F.col(place).cast("long")), "_key", gone, "_maybe")
    stay = rows.where("_maybe").join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    return restored(rows.where("not _maybe").unionByName(stay), names)
