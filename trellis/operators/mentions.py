"""Mentions of a lexicon of any size in a corpus: buffers of lines, matches by prefix, the first mention of every name.

A lexicon of up to HELD names goes to the tasks, which walk each buffer once, leftmost first, the longest at a place, none
overlapping. A larger one stays a table: what tasks get of it is a bitmap of fixed size, in which its prefixes are marked;
places of a text whose prefix is marked become rows and meet the names of that prefix in a join, and a buffer's matches are
walked likewise. Both ways give the same rows.

Defined cases: names are SPAN characters long, the first node type of a name counts; a null text has no lines; lines that
are blank or match ``skip`` are passed over; a line longer than the size is a buffer of its own, as far as none is open;
equal first places: the lesser key; empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws

#: Shortest and longest name; characters of a prefix (shorter names: all of theirs); bits of the map.
SPAN, PREFIX, BITS = (2, 20), 4, 1 << 20
#: Names that tasks hold at most, of SPAN characters each: some 20 MB.
HELD = 1 << 18


def lexicon(parts: list[DataFrame], types: list[str]) -> DataFrame:
    """name, node_type of the given types: of equal names the first part's, in a part the least ordinal's."""
    rows = reduce(DataFrame.unionByName, [p.select("ordinal", "name", "node_type").withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    fits = F.col("node_type").isin(*types) & F.length("name").between(*SPAN)
    return rows.where(fits).groupBy("name").agg(F.min_by("node_type", F.struct("part", "ordinal")).alias("node_type"))


def buffers(lines: DataFrame, key: str, size: int, skip: str | None = None) -> DataFrame:
    """key, start, n_lines, text of (key, line_no, line): lines are gathered until their lengths reach ``size``, then anew.

    Only numbers and lengths are folded; a buffer is as long as the size and one line at most."""
    bare = lines.select(key, "line_no", strip_ws(F.col("line")).alias("line")).where("line <> ''")
    bare = bare.where(~F.col("line").rlike(skip)) if skip else bare
    sized = bare.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", F.length("line").cast("long").alias("n")))).alias("l"))
    state = F.struct(F.lit(0).cast("long").alias("run"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s, x):  # noqa: ANN001, ANN202
        run = s["run"] + x["n"]
        return F.struct(F.when(run >= size, 0).otherwise(run).cast("long").alias("run"), (s["at"] + 1).alias("at"), F.when(s["run"] == 0, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

    folded = sized.select(key, "l", F.aggregate("l", state, step, lambda s: s["starts"]).alias("s"))
    ranges = folded.select(key, "l", F.explode(F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("r"))
    first = F.element_at("l", F.col("r.a"))
    members = ranges.select(key, first["line_no"].alias("start"), F.explode(F.slice("l", F.col("r.a"), F.coalesce("r.b", F.size("l") + 1) - F.col("r.a"))).alias("m")).select(key, "start", F.col("m.line_no").alias("line_no"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return bare.join(members, [key, "line_no"]).groupBy(key, "start").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("text"))


def _marks(codes: np.ndarray, k: int) -> np.ndarray:
    """Bits of all stretches of k characters."""
    h = np.full(len(codes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h * np.uint64(0x100000001B3) ^ codes[j : len(codes) - k + 1 + j]) & np.uint64(0xFFFFFFFFFFFF)
    return (h ^ (h >> np.uint64(23))) % np.uint64(BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def bitmap(names: DataFrame) -> bytes:
    """The map of all prefixes: BITS / 64 words at most, whatever the lexicon's size."""

    @F.pandas_udf("long")
    def bit(prefix: pd.Series) -> pd.Series:
        return prefix.map(lambda p: int(_marks(_codes(p), len(p))[0]))

    marked = names.select(F.substring("name", 1, PREFIX).alias("p")).distinct().select(bit("p").alias("b"))
    words = marked.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("bits"))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for w, bits in words.collect():
        out[w] = bits
    return out.tobytes()


def candidates(chunks: DataFrame, key: list[str], marked: bytes) -> DataFrame:
    """key, at, prefix, window of every place whose prefix of some length is marked."""
    schema = ", ".join(f"{c} {t}" for c, t in chunks.select(*key).dtypes) + ", at long, prefix string, window string"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(marked, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                codes, found = _codes(text), []
                for k in range(SPAN[0], PREFIX + 1):
                    if len(codes) >= k:
                        found += [(at, k) for at in np.flatnonzero(known[_marks(codes, k)]).tolist()]
                own = [batch.column(c).take(pa.array([i] * len(found), pa.int64())) for c in key]
                more = [pa.array([at for at, _ in found], pa.int64()), pa.array([text[at : at + k] for at, k in found], pa.string()), pa.array([text[at : at + SPAN[1]] for at, _ in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *more], [*key, "at", "prefix", "window"])

    return chunks.select(*key, "text").mapInArrow(places, schema)


def mentions(chunks: DataFrame, key: list[str], names: DataFrame, held: int = HELD) -> DataFrame:
    """key, name, node_type, at: the distinct names that each chunk mentions, with their first place."""
    names = names.where(F.length("name").between(*SPAN)).select("name", "node_type")
    known = names.limit(held + 1).collect()
    return _walked(chunks, key, dict(map(tuple, known))) if len(known) <= held else _joined(chunks, key, names)


def _walked(chunks: DataFrame, key: list[str], types: dict[str, str]) -> DataFrame:
    """Mentions of names that tasks hold."""
    sizes: dict[str, set[int]] = {}
    for name in types:
        sizes.setdefault(name[:PREFIX], set()).add(len(name))
    lengths = {p: sorted(ns, reverse=True) for p, ns in sizes.items()}
    schema = ", ".join(f"{c} {t}" for c, t in chunks.select(*key).dtypes) + ", at long, name string, node_type string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, found = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                at, seen, last = 0, set(), len(text) - SPAN[0]
                while at <= last:
                    name = None
                    for k in range(PREFIX, SPAN[0] - 1, -1):  # names shorter than a prefix are their own
                        for n in lengths.get(text[at : at + k], ()):
                            if (word := text[at : at + n]) in types:
                                name = word
                                break
                        if name:
                            break
                    if name is None:
                        at += 1
                        continue
                    if name not in seen:
                        seen.add(name)
                        rows.append(row)
                        ats.append(at)
                        found.append(name)
                    at += len(name)
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in key]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ats, pa.int64()), pa.array(found, pa.string()), pa.array([types[n] for n in found], pa.string())], [*key, "at", "name", "node_type"])

    return chunks.select(*key, "text").mapInArrow(walk, schema)


def _joined(chunks: DataFrame, key: list[str], names: DataFrame) -> DataFrame:
    """Mentions of names in a table of any size."""
    prefixed = names.select("name", "node_type", F.substring("name", 1, PREFIX).alias("prefix"))
    met = candidates(chunks, key, bitmap(names)).join(prefixed, "prefix").where(F.col("window").startswith(F.col("name")))
    met = met.select(*key, "at", F.length("name").alias("n"), "name", "node_type")

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("n", "descending")])
        kept, end, seen = [], 0, set()
        for i, (at, n, name) in enumerate(zip(*[group.column(c).to_pylist() for c in ("at", "n", "name")])):
            if at >= end:
                end = at + n
                if name not in seen:
                    seen.add(name)
                    kept.append(i)
        return group.take(pa.array(kept, pa.int64())).drop_columns(["n"])

    return met.groupBy(*key).applyInArrow(walk, met.drop("n").schema)


def first_mentions(found: DataFrame, key: list[str]) -> DataFrame:
    """name, node_type, the key of the first chunk that mentions it, and how many chunks do."""
    return found.groupBy("name", "node_type").agg(F.min(F.struct(*key)).alias("_k"), F.count(F.lit(1)).alias("n_chunks")).select("name", "node_type", *[F.col(f"_k.{c}").alias(c) for c in key], "n_chunks")
