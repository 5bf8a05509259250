"""SimHash near-duplicates found through pivot distance tables.

Fingerprints. 64 bits from the XXH64 of a text's word shingles, repeats included.

Pivots. The reference fingerprints are a base and ``PIVOTS`` others that differ from it in one small block of bits
each, all blocks apart. The table of a fingerprint holds its distances to all of them. Distances to references drawn
at random are of little use here: those of any two fingerprints differ by two or less about a third of the time. The
distance to a pivot above that to the base moves only with the bits of the pivot's block, by at most two a bit.

Candidates. Where two fingerprints are at most two bits apart, so are their distances to every reference, and their
pivot coordinates (half of the distance above the base's) differ by one step in at most two pivots, or by two steps
in one. So both are within one step of some coordinate vector. Each fingerprint is filed under its own vector and all
vectors one step away; only fingerprints filed together are compared. Of these a pair is discarded if its
maximum coordinate difference over all references is above ``RADIUS``; survivors are verified by exact distance.

Crowded files. A file of more than ``CROWD`` fingerprints is never paired. Its members are filed again by a second
table, with a pivot for every single bit: vectors one step away then are the fingerprint's ball of radius one, two
fingerprints are within two bits if and only if their balls meet, and joining every member to the least of a
file gives the same components. That is linear in the members, whatever the file's size.

Links become components by alternating large and small stars over distinct fingerprints, each round written
to the shared folder.

Defined cases: null or empty text: fingerprint zero, which links like any other; null doc_id: kept, ignored
as a smallest id (a component of nulls alone has a null id); repeated rows: returned each; empty table: no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alike
from .common import discard, stash

SHINGLE, SEED = 3, 42
PIVOTS, RADIUS, CROWD = 32, 2, 256
#: Bits of a pivot's block.
BLOCK = 64 // PIVOTS
#: The base reference; any constant would do.
BASE = 0x9E3779B97F4A7C15
#: Shingles hashed at a time.
CHUNK = 1 << 15


def references() -> np.ndarray:
    """The base, then the pivots: pivot j differs from it in the bits of block j."""
    masks = [((1 << BLOCK) - 1) << (j * BLOCK) for j in range(PIVOTS)]
    return np.array([BASE, *(BASE ^ m for m in masks)], dtype=np.uint64)


REFERENCES = references()
#: What a step in each pivot's coordinate (0 to BLOCK) adds to the number of a coordinate vector.
STEPS = np.array([(BLOCK + 1) ** j for j in range(PIVOTS)], np.int64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint (rows) to each reference (columns)."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def files_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, file) for the coordinate vector of every row of a distance table and all vectors one step away."""
    at = (BLOCK - (table[:, 1:] - table[:, :1])) // 2
    own, rows = at @ STEPS, np.arange(len(table))
    down, up = np.nonzero(at > 0), np.nonzero(at < BLOCK)
    return np.concatenate([rows, down[0], up[0]]), np.concatenate([own, own[down[0]] - STEPS[down[1]], own[up[0]] + STEPS[up[1]]])


def fingerprint(text: bytes | None) -> int:
    """Of one whole text. Lower-cases A-Z; bytes.split() divides at the six ASCII white-space characters."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = (ends[-n:] if len(words) >= SHINGLE else ends[-1:]).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(t.as_py())) for t in batch.column("_t")]
        names = [c for c in batch.schema.names if c != "_t"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _text (a hash of the text), print (the 64 bits as a long) for every row, stashed."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("_t"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return stash(texts.mapInArrow(_prints, f"doc_id {kind}, _text long, print long"), "prints")


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy()
        rows, files = files_of(distance_table(prints.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(prints[rows], pa.int64())], ["file", "print"])


def _linked(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the members of one file as all their pairs within RADIUS would."""
    prints = np.unique(prints)
    table, parent = distance_table(prints.view(np.uint64)), list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(len(prints) - 1):
        near = np.flatnonzero(np.abs(table[a + 1 :] - table[a]).max(axis=1) <= RADIUS) + a + 1
        for b in near[np.bitwise_count(prints[near].view(np.uint64) ^ prints[a].view(np.uint64)) <= RADIUS].tolist():
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [(int(prints[x]), int(prints[root(x)])) for x in range(len(prints)) if root(x) != x]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [p for row in batch.column("prints") if len(row.values) > 1 for p in _linked(row.values.to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between the distinct fingerprints of column ``print`` with the components of all pairs within RADIUS."""
    distinct = prints.select("print").distinct()
    filed = stash(distinct.mapInArrow(_filed, "file long, print long"), "filed")
    # sizes first, from counts that add up map-side; no list is built of a crowded file
    sizes = filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stash(sizes, "files")
    shared = filed.join(sizes.where(F.col("n") <= CROWD), "file")
    lists = shared.groupBy("file").agg(F.collect_list("print").alias("prints")).select("prints")
    near = lists.mapInArrow(_compared, "a long, b long")
    crowded = filed.join(sizes.where(F.col("n") > CROWD), "file", "left_semi").select("print").distinct()
    ball = crowded.select("print", F.explode(F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("centre"))
    least = ball.groupBy("centre").agg(F.min("print").alias("b"), F.max("print").alias("_most")).where("b < _most").select("centre", "b")
    met = ball.join(least, "centre").select(F.col("print").alias("a"), "b").where("a != b")
    return near.unionByName(met).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """a (every node that has a link), root (the least node reachable).

    Large star: each node's greater neighbours move to its least neighbour. Small star: its lesser neighbours
    and itself do. Both shrink towards stars; a round that changes no row ends it. No node's neighbours are
    gathered: minima are aggregates, and the rest are joins that may be split.
    """
    now, before = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stash(large.where("a != b").distinct(), "large")
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        after = stash(small.where("a != b").distinct(), "small")
        discard(large)
        if before is not None:
            discard(before)
        same = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        if same.first() == now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first():
            return after.select("a", F.col("b").alias("root"))
        before, now = now, after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def alike_groups(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _root for every row of ``docs``: groups of texts that share four fifths of their five-word
    shingles. Fingerprints of these go through the pivot tables and are verified; ``alike`` adds what they miss."""
    prints, found = alike.links(docs, links, components)
    roots = components(found).select(F.col("a").alias("_p"), "root")
    return prints.join(roots, F.col("print") == F.col("_p"), "left").select("doc_id", "_text", F.coalesce("root", "print").alias("_root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, and _text, _root for every row of ``docs``."""
    prints = fingerprints(docs)
    least = prints.groupBy("print").agg(F.min("doc_id").alias("low"))
    roots = components(links(prints)).withColumnRenamed("a", "print")
    placed = stash(least.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"), "low"), "placed")
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stash(placed.join(lows, "root").select(F.col("print").alias("_p"), F.col("root").alias("_root"), "component_id"), "named")
    joined = prints.join(named, F.col("print") == F.col("_p"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "_text", "_root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of alike texts, with all its columns: the one of the least doc_id (and, where rows share
    it, of the least text hash; of rows that repeat both, any one)."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("_text").alias("text"))).alias("f")
    rows = stash(alike_groups(docs).groupBy("_root", "doc_id", "_text").agg(F.count(F.lit(1)).alias("n")), "grouped")
    firsts = rows.groupBy("_root").agg(first).select(F.col("f.id").alias("_id"), F.col("f.text").alias("_h"))
    # the narrow side is hashed, so that the texts are neither sorted nor spilled; the row is one column, whatever its names
    one = stash(rows.join(firsts, rows.doc_id.eqNullSafe(firsts._id) & (rows._text == firsts._h)).select("_id", "_h", "n"), "firsts")
    whole = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    is_in = lambda part: whole.doc_id.eqNullSafe(part._id) & (whole._text == part._h)
    single = one.where("n = 1").hint("shuffle_hash")
    kept = whole.join(single, is_in(single), "left_semi")
    several = one.where("n > 1")
    if not several.isEmpty():
        kept = kept.unionByName(whole.join(several, is_in(several), "left_semi").dropDuplicates(["doc_id", "_text"]))
    return kept.select("_row.*")
