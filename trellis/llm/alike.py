"""Pairs of texts that share most of their word shingles, exactly.

Two texts are alike if the Jaccard index of their sets of ``SHINGLE``-word shingles is ``SIMILARITY`` or more.

SimHash first. The fingerprints of the sets go through the pivot tables of ``simhash``, and every text is verified
against one text of the group that its fingerprint is linked to. That joins most copies. But alike texts may differ
by ten bits and more of 64, and files that are sure to hold such pairs would need thousands of keys for each
text. The shingles themselves find the rest:

1. Order. In any one order of all shingles, two alike texts of n shingles or more have one in common among
   the first n - ceil(SIMILARITY n) + 1 of each (prefix filtering). Shingles are ordered by hash, except that
   those which a first pass finds in over ``COMMON`` texts' prefixes come last, the most frequent at the end:
   a line in many texts then files a text only if there is little else in it. The order decides on cost alone.
2. Files. Texts are filed under the shingles of their prefix. In files of up to ``CROWD`` texts all pairs of
   fitting sizes are candidates, and each is verified against both whole sets.
3. In crowded files every text is first paired with the one that has the least before the file's shingle in
   its prefix (the fewest rare shingles). Only pairs that the components of all these links leave apart follow,
   all of them, each in the first of its files: pairs within a component could not change it. So a crowd of copies
   costs no more than its size; what is left are texts just below the similarity, which must be compared.
4. A pair is no candidate where the sizes, or the shingles that are left behind the first common one, are
   too few for the similarity, or where more bits of the sets' maps differ than shingles may. A bit of a map
   is the parity of the shingles that fall on it, so no more bits differ than shingles do. Files carry small
   maps; candidates are then held against wide ones, which leave few but alike pairs to be verified on their texts.

Sets hold 64-bit hashes of shingles. Words and case are those of the fingerprints; texts of under SHINGLE
words are one shingle; null and empty texts are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
COMMON, CROWD = 64, 64
#: Shingles that are put last, at most; more of them than this keep their places by hash.
LATE = 1 << 18
#: Parts that the members of a crowded file are dealt into.
SALTS = 4
#: Of a text's crowded files so many are remembered to tell which of a pair's files comes first; more only repeat pairs.
FIRST = 8
#: Longs of 64 bits in the map of a set that goes with its files, and in the one that each candidate pair is held against.
MAPS, WIDE = 4, 32
#: Words whose hashes a worker keeps.
VOCABULARY = 1 << 17
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


FACTORS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (signed) of the shingles of one text; of an empty text one that stands for it."""
    words = (text or b"").lower().split()
    hashes = np.empty(max(len(words), 1), np.uint64)
    hashes[0] = 0
    for i, w in enumerate(words):
        h = _words.get(w)
        if h is None:
            if len(_words) >= VOCABULARY:
                _words.clear()
            h = _words[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = h
    size = min(shingle, len(hashes))
    n = len(hashes) - size + 1
    mixed = np.full(n, size if words else 0, np.uint64)
    for k in range(size):
        mixed += hashes[k : k + n] * FACTORS[k]
    return np.unique(_mixed(mixed).view(np.int64))


def parity_maps(own: np.ndarray, longs: int = MAPS) -> np.ndarray:
    """``longs`` signed longs."""
    odd = np.bincount(own & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_print(own: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if set in over half of the hashes (signed)."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def prefix_size(n: int) -> int:
    return n - -(-n * SIMILARITY.numerator // SIMILARITY.denominator) + 1


def fits(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return small * SIMILARITY.denominator >= large * SIMILARITY.numerator


def are_alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(fits(both, len(a) + len(b) - both))


def words_key(text: bytes | None) -> int:
    """Of the lower-cased words: texts of equal key have equal shingles in equal order."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), 1)).view(np.int64))


def _prefixes(late: np.ndarray):
    """(..., _t) batches to (..., print, n, simhash, maps, wide, prefix), the last three as arrays; ``late`` are the shingles that come last, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(late)
        sorted_ = late[by_hash]
        for batch in batches:
            prints, sizes, hashes, maps, wide, found = [], [], [], [], [], []
            for t in batch.column("_t"):
                data = t.as_py()
                own = shingle_set(data)
                p = prefix_size(len(own))
                maps.append(parity_maps(own))
                wide.append(parity_maps(own, WIDE))
                hashes.append(set_print(own))
                if len(late):
                    at = np.minimum(np.searchsorted(sorted_, own), len(late) - 1)
                    is_late = sorted_[at] == own
                    if is_late.any():
                        own = np.concatenate([own[~is_late], late[np.sort(by_hash[at[is_late]])]])
                prints.append(words_key(data))
                sizes.append(len(own))
                found.append(own[:p])
            names = [c for c in batch.schema.names if c != "_t"]
            arrays = [pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], [*names, "print", "n", "simhash", "maps", "wide", "prefix"])

    return work


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_t) batches to (print, packed): a compressed text takes a fraction of the room of its set."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        data = [t.as_py() or b"" for t in batch.column("_t")]
        yield pa.RecordBatch.from_arrays([pa.array([words_key(t) for t in data], pa.int64()), pa.array([pack(t) for t in data], pa.binary())], ["print", "packed"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    last, own = None, None
    for batch in batches:
        good = []
        for a, x, y in zip(batch.column("a"), batch.column("packed"), batch.column("packed_b")):
            if a.as_py() != last:
                last, own = a.as_py(), shingle_set(unpack(x.as_py()))
            good.append(are_alike(own, shingle_set(unpack(y.as_py()))))
        good = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def _bounded(pairs: DataFrame) -> DataFrame:
    """Those pairs (a, n, pos, b, n_b, pos_b) that may be alike. Behind the first common shingle (least pos of
    both in the pair's files) no more can be common than is left of either set."""
    least = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("n_b").alias("n_b"), F.min("pos").alias("pos"), F.min("pos_b").alias("pos_b"))
    return least.where(_enough()).select("a", "b")


def _enough():
    """Whether sizes n, n_b with a common shingle at pos, pos_b, the first, allow the similarity."""
    left, num, den = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")), SIMILARITY.numerator, SIMILARITY.denominator
    return left * (num + den) >= (F.col("n") + F.col("n_b")) * num


def _fitting():
    """Whether sizes and maps allow the similarity: of n + n_b no more than their share may be in one set only."""
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    differ = sum(F.bit_count(F.col(f"map{i}").bitwiseXOR(F.col(f"map{i}_b"))) for i in range(MAPS))
    return (F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num) & (differ * (num + den) <= (F.col("n") + F.col("n_b")) * (den - num))


def _pairs(files: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of a member of ``files`` and one of ``other`` of the same file."""
    renamed = other.select("shingle", F.col("print").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), *[F.col(c).alias(c + "_b") for c in ("root", "salt", "before", *[f"map{i}" for i in range(MAPS)]) if c in other.columns])
    on = ["shingle", "salt"] if "salt" in files.columns else ["shingle"]
    if "salt" in files.columns:
        renamed = renamed.withColumnRenamed("salt_b", "salt")
    return files.withColumnRenamed("print", "a").join(renamed, on).where(_fitting())


def _alike(rows: DataFrame, chosen: DataFrame, wide: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose whole sets are alike. ``rows``: _text, _t; ``chosen``: a text for each print;
    ``wide``: print, n, wide."""
    bare = stash(pairs, "candidates")
    both = bare.join(wide.select(F.col("print").alias("a"), "n", "wide"), "a").join(wide.select(F.col("print").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b")), "b")
    differ = F.aggregate(F.zip_with("wide", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    pairs = stash(both.where(differ * (num + den) <= (F.col("n") + F.col("n_b")) * (den - num)).select("a", "b"), "pairs")
    discard(bare)
    wanted = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct()
    wanted = stash(chosen.join(wanted, "print", "left_semi").select("_h"), "wanted")
    packed = rows.join(wanted, F.col("_text") == F.col("_h"), "left_semi").select("_t").mapInArrow(_packed, "print long, packed binary")
    packed = stash(packed.groupBy("print").agg(F.first("packed").alias("packed")), "packed")
    both = pairs.join(packed.withColumnRenamed("print", "a"), "a").join(packed.select(F.col("print").alias("b"), F.col("packed").alias("packed_b")), "b")
    links = stash(both.select("a", "b", "packed", "packed_b").mapInArrow(_verified, "a long, b long"), "alike")
    for done in (packed, wanted, pairs):
        discard(done)
    return links


def links(docs: DataFrame, near, components) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _text, print for every row; a, b: links between prints with the components of all alike pairs).

    ``near`` turns fingerprints (column print) into links a, b, and ``components`` links into (a, root).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("_t"))
    schema = f"doc_id {kind}, _text long, print long, n int, simhash long, maps array<long>, wide array<long>, prefix array<long>"
    first = stash(rows.mapInArrow(_prefixes(np.zeros(0, np.int64)), schema).select("doc_id", "_text", "print", "prefix"), "prefixes")
    prints = stash(first.select("doc_id", "_text", "print"), "prints")
    chosen = stash(prints.groupBy("print").agg(F.min("_text").alias("_h")), "chosen")
    once = first.groupBy("print").agg(F.first("prefix").alias("prefix"))
    counts = once.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > COMMON)
    late = np.array([r.shingle for r in reversed(counts.orderBy(F.desc("m"), "shingle").limit(LATE).collect())], np.int64)
    discard(first)

    own = rows.mapInArrow(_prefixes(late), schema).groupBy("print").agg(F.first(F.struct("n", "simhash", "maps", "wide", "prefix")).alias("f"))
    texts = stash(own.select("print", "f.n", "f.simhash", "f.maps", "f.wide", "f.prefix"), "own")
    wide = texts.select("print", "n", "wide")
    # SimHash: each text with the least of its group of linked fingerprints
    groups = components(near(texts.select(F.col("simhash").alias("print")))).select(F.col("a").alias("_of"), F.col("root").alias("_group"))
    grouped = stash(texts.select("print", "simhash").join(groups, F.col("simhash") == F.col("_of"), "left").select("print", F.coalesce("_group", "simhash").alias("_group")), "fingerprints")
    heads = grouped.groupBy("_group").agg(F.min("print").alias("a"), F.max("print").alias("_last")).where("a < _last").select("_group", "a")
    hashed = grouped.join(heads, "_group").where("a != print").select("a", F.col("print").alias("b"))

    spread = texts.select("print", "n", F.posexplode("prefix").alias("pos", "shingle"))
    sizes = stash(spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "files")
    filed = stash(spread.join(sizes, "shingle"), "filed")
    maps = filed.select("print").distinct().join(texts.select("print", *[F.col("maps")[i].alias(f"map{i}") for i in range(MAPS)]), "print")
    bare, filed = filed, stash(filed.join(maps, "print"), "mapped")
    discard(bare)
    small, crowded = filed.where(F.col("m") <= CROWD).drop("m"), filed.where(F.col("m") > CROWD).drop("m")
    pairs = _pairs(small, small).where("a < b")
    least = F.min(F.struct("pos", "print", "n", *[f"map{i}" for i in range(MAPS)])).alias("f")
    pivots = crowded.groupBy("shingle").agg(least).select("shingle", F.col("f.print").alias("print"), F.col("f.n").alias("n"), F.col("f.pos").alias("pos"), *[F.col(f"f.map{i}").alias(f"map{i}") for i in range(MAPS)])
    hubs = _pairs(crowded, pivots).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _alike(rows, chosen, wide, _bounded(pairs).union(hubs).union(hashed).distinct())
    if not crowded.isEmpty():
        roots = components(found).withColumnRenamed("a", "print")
        crowded = stash(crowded.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "crowded")
        mixed = crowded.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
        apart = stash(crowded.join(mixed, "shingle", "left_semi"), "apart")
        firsts = apart.groupBy("print").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "shingle"))), 1, FIRST).alias("_firsts"))
        before = F.transform(F.filter("_firsts", lambda f: f.pos < F.col("pos")), lambda f: f.shingle)
        apart = apart.join(firsts, "print").withColumn("before", before).drop("_firsts")
        salted = apart.withColumn("salt", F.pmod(F.hash("print"), F.lit(SALTS)))
        dealt = apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = _pairs(salted, dealt).where("a < b and root != root_b and not arrays_overlap(before, before_b)")
        found = found.union(_alike(rows, chosen, wide, _bounded(rest)))
    discard(filed)
    discard(texts)
    return prints, found.distinct()
