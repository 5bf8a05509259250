"""Language identification by cross-parsing entropy.

A language is learned as the suffix automaton of a sample of its labelled texts: from its root exactly the strings of
the sample can be walked. A text is parsed against each automaton: every phrase is the longest match from where the
last one ended (a byte the sample lacks ends a phrase too). A phrase costs log2 of the sample's size, as much as
pointing into it; the language with the fewest bits a text byte wins, ties to the lesser name. Score: how far below
the second-best language's bits the winner's are, (second - first) / second.

Texts are normalised: lower case, everything but letters and marks one space, in UTF-8. They are parsed in lanes of
LANE bytes from their start, a whole batch's lanes a byte at a time in NumPy; a lane's first phrase starts afresh.
No text is shuffled: a sample's documents are chosen by digest, and only they leave their tasks.

The samples are bounded (DOCUMENTS texts and SAMPLE bytes a language, LANGUAGES languages of most distinct texts);
prediction reads every whole text. Copies of a text count once in a sample.

Defined cases: null text or one without a letter: ``und``, score 0; null lang: never learned; null doc_id: digest of
the empty text (not held out); nothing labelled: every text ``und``; one language: it, score 1; repeated rows are
predicted each; empty table: no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import stash

UND = "und"
#: Bounds of what is learned: bytes and documents a language, languages.
SAMPLE, DOCUMENTS, LANGUAGES = 48_000, 400, 64
#: Bytes parsed in one go, lanes parsed side by side, bytes of dense transition tables that a worker keeps.
LANE, ABREAST, KEPT = 1024, 8192, 256 << 20
FRACTION = 1 << 24


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def excerpt(texts: list[bytes], digests: list[int], size: int) -> bytes:
    """About ``size`` bytes out of all texts: each gives an equal share, short ones all they have, from a place that its
    digest chooses; newlines, which no normalised text holds, keep matches inside one text."""
    parts, left = [], size
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), digests[i]))
    for k, i in enumerate(order):
        take = min(len(texts[i]), left // (len(order) - k))
        start = digests[i] % (len(texts[i]) - take + 1)
        parts.append(texts[i][start : start + take])
        left -= take
    return b"\n".join(parts)


def automaton(text: bytes) -> np.ndarray:
    """Transitions (state, byte, next) of the suffix automaton, states from 0, the root."""
    arcs: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for b in text:
        now = len(arcs)
        arcs.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and b not in arcs[at]:
            arcs[at][b] = now
            at = link[at]
        if at >= 0:
            to = arcs[at][b]
            if longest[to] == longest[at] + 1:
                link[now] = to
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and arcs[at].get(b) == to:
                    arcs[at][b] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    return np.array([(s, b, t) for s, out in enumerate(arcs) for b, t in out.items()], dtype=np.int32).reshape(-1, 3)


def learn_group(group: pd.DataFrame) -> pd.DataFrame:
    """One language's chosen texts to its automaton."""
    text = excerpt([t.encode() for t in group["text"]], [int(d) for d in group["digest"]], SAMPLE)
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "size": [len(text)], "arcs": [automaton(text).tobytes()]})


def learn(docs: DataFrame) -> DataFrame:
    """lang, size, arcs of every language among the labelled rows that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "text").where(F.col("text").rlike(r"\p{L}"))
    labelled = labelled.withColumn("digest", F.abs(F.xxhash64("text") % (1 << 62)))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("digest").alias("n"))
    counts = stash(counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES), "languages")
    share = F.col("digest") % FRACTION < FRACTION * DOCUMENTS / F.col("n")
    # LANGUAGES rows are broadcast; a long text gives SAMPLE characters from a place that its digest chooses
    chosen = labelled.join(F.broadcast(counts), "lang").where(share)
    chosen = chosen.withColumn("text", normalised(F.col("text")))
    start = 1 + F.col("digest") % (F.greatest(F.length("text") - SAMPLE, F.lit(0)) + 1)
    chosen = chosen.select("lang", "digest", F.substring("text", start, F.lit(SAMPLE)).alias("text"))
    chosen = chosen.groupBy("lang", "digest").agg(F.min("text").alias("text"))
    return stash(chosen.groupBy("lang").applyInPandas(learn_group, "lang string, size long, arcs binary"), "automata")


class Parser:
    """One language: phrases of many lanes at a time."""

    def __init__(self, lang: str, size: int, arcs: bytes):
        self.lang, self.arcs = lang, np.frombuffer(arcs, dtype=np.int32).reshape(-1, 3)
        self.bits = float(np.log2(size + 1))
        used = np.unique(self.arcs[:, 1])
        # byte to column; column 0 has no transitions
        self.columns = np.zeros(256, dtype=np.int32)
        self.columns[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.states = int(self.arcs[:, 2].max(initial=0)) + 1
        self._table = None

    @property
    def weight(self) -> int:
        return 4 * self.states * self.width

    def table(self, keep: bool) -> np.ndarray:
        """Flat: state's offset + column gives the next state's offset, 0 for none (nothing leads to the root)."""
        if self._table is not None:
            return self._table
        table = np.zeros(self.states * self.width, dtype=np.int32)
        table[self.arcs[:, 0] * self.width + self.columns[self.arcs[:, 1]]] = self.arcs[:, 2] * self.width
        if keep:
            self._table = table
        return table

    def phrases(self, lanes: np.ndarray, alive: np.ndarray, keep: bool) -> np.ndarray:
        """lanes[t] holds byte t of every lane, longest lanes first; alive[t] lanes are longer than t."""
        table, columns = self.table(keep), self.columns
        first = table[: self.width]
        at, count = np.zeros(lanes.shape[1], dtype=np.int32), np.ones(lanes.shape[1], dtype=np.int32)
        for t, k in enumerate(alive):
            c = columns[lanes[t, :k]]
            to = table[at[:k] + c]
            miss = to == 0
            count[:k] += miss
            at[:k] = np.where(miss, first[c], to)
        return count


def parse(parsers: list[Parser], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phrases of every text (a range of ``data``) for every language."""
    lanes = np.maximum((ends - starts + LANE - 1) // LANE, 0)
    owner = np.repeat(np.arange(len(starts)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = starts[owner] + nth * LANE
    length = np.minimum(ends[owner] - begin, LANE)
    order = np.argsort(-length, kind="stable")
    keep = sum(p.weight for p in parsers) <= KEPT
    total = np.zeros((len(parsers), len(starts)), dtype=np.int64)
    for part in (order[i : i + ABREAST] for i in range(0, len(order), ABREAST)):
        most = int(length[part[0]])
        places = begin[part][None, :] + np.arange(most)[:, None]
        block = data[np.minimum(places, len(data) - 1)]
        alive = np.searchsorted(-length[part], -np.arange(most), side="left")
        for k, p in enumerate(parsers):
            np.add.at(total[k], owner[part], p.phrases(block, alive, keep))
    return total


_loaded: dict = {}


def predict_batches(batches: Iterator[pa.RecordBatch], model, key: str) -> Iterator[pa.RecordBatch]:
    """Batches with a normalised text ``_t`` (null: no letter) to lang_pred and score."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = [Parser(*row) for row in model.value]
    parsers = _loaded[key]
    names = np.array([p.lang for p in parsers] + [UND], dtype=object)
    bits = np.array([p.bits for p in parsers])
    for batch in batches:
        texts = batch.column("_t").cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        known = texts.is_valid().to_numpy(zero_copy_only=False) & (len(parsers) > 0)
        best, score = np.full(len(texts), len(parsers)), np.zeros(len(texts))
        if known.any():
            cost = parse(parsers, data, offsets[:-1][known], offsets[1:][known]) * bits[:, None]
            best[known] = cost.argmin(axis=0)
            two = np.sort(cost, axis=0)[:2]
            score[known] = (two[1] - two[0]) / two[1] if len(parsers) > 1 else 1.0
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_t"]
        fields = [n for n in batch.schema.names if n != "_t"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*fields, "lang_pred", "score"])


def predict(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``; ``model``: what ``learn`` gives (bounded)."""
    rows = sorted((r.lang, r.size, bytes(r.arcs)) for r in model.collect())
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), repr([(lang, size, hash(arcs)) for lang, size, arcs in rows])
    text = normalised(F.col("text"))
    told = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), text).alias("_t"))
    schema = StructType([*told.drop("_t").schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return told.mapInArrow(lambda batches: predict_batches(batches, shared, key), schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows of ``docs`` and predicts all of them."""
    return predict(docs, learn(docs))
