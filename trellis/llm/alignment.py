"""Alignment of two tokenizers' tokens, each distinct segment of the texts once.

A is a byte-level vocabulary that gets a space and the text, B a piece vocabulary that puts that space itself. Texts are
cut before runs of white space where neither can merge across, which is verified on the vocabularies at load:

* A's pre-tokenizer ends a part at white space that follows anything else, and merges stay in a part;
* no piece of B has the run's first character behind anything but white space, so no merge joins the two sides; B's
  normaliser leaves every character alone, and no piece starts with the space mark and another white space, so the mark
  that B puts before a segment can be taken off again.

Where one does not hold for a vocabulary, and in texts with U+2581 or NUL, a text is one segment. Tasks cut their texts in
blocks of BLOCK characters, number a block's distinct segments and write texts as numbers. The segments are dealt by
their text, once a block however often they occur, and sorted, so that equal ones meet; each is tokenized and aligned
once, and its groups go back to every block that holds it, packed by block. Links are counted by pair of ids over all
segments and blocks; a block gets the counts of its own pairs, and its documents are composed.

Two tokens are linked where their byte ranges end together, which is also where a group ends, so a text has as many
links as groups.

Defined cases: null, empty, or bytes of A or B other than the space and the text: no tokens, zeros, empty groups; white
space alone: one segment; repeated rows and ids: each its own row, and each counts; empty table: no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .tokens import byte_letters

#: Characters of text in a block: bounds what a task and a composed group hold (a longer text is a block of its own).
BLOCK = 16_000_000
#: Rows of one answer; segments whose groups are packed by block together.
ROWS, PACKED = 10_000, 200_000
SPACE_MARK = "▁"
#: White space before which texts may be cut, if the vocabularies allow.
CUTS = " \t\n\x0b\x0c\r"
_loaded: dict = {}


class Vocabularies:
    """Both tokenizers, their tokens' bytes, and where texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            conf = json.load(f)
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = {c: b for b, c in byte_letters().items()}
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(SPACE_MARK)
        pre = conf.get("pre_tokenizer") or {}
        parted = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        spaced = [p.replace(SPACE_MARK, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        cuts = [c for c in CUTS if not any(c in p and self.joins(p, c) for p in spaced)] if parted and self.plain() else []
        self.cuts = "".join(cuts)
        if " " in cuts:
            unsafe = "[^\\S" + re.escape(self.cuts) + "]"  # white space before which no cut is made
            self.segments = re.compile(rf"\s+\S*(?:{unsafe}\s*\S*)*").findall
        else:
            self.segments = lambda text: [text]

    @staticmethod
    def joins(piece: str, c: str) -> bool:
        """Whether the piece holds c behind something that is no white space, or (no space itself) behind a space."""
        return any(x == c and (not piece[i - 1].isspace() or c != " " == piece[i - 1]) for i, x in enumerate(piece) if i)

    def plain(self) -> bool:
        """The normaliser leaves every character alone but writes spaces as marks."""
        probe = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != SPACE_MARK)
        return all(self.b.normalize(x) == SPACE_MARK + x.replace(" ", SPACE_MARK) for x in (probe, "A  b\tc  ", " é\n"))

    def cut(self, text: str) -> list[str]:
        """The segments of a space and the text."""
        return [" " + text] if SPACE_MARK in text or "\x00" in text else self.segments(" " + text)

    def align(self, segments: list[str]) -> list[tuple[list[int], list[int], list[tuple[int, int]]] | None]:
        """A's ids, B's ids and the ends of groups in both (numbers of tokens), or None where bytes differ."""
        of_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        of_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        out = []
        for segment, a, b in zip(segments, of_a, of_b):
            if segment[0] != " ":
                b = b[1:]  # the mark that B has put before it
            elif len(segment) == 1:
                b = [self.mark]  # nothing is left to encode
            whole = segment.encode()
            a_parts, b_parts = [self.a_bytes.get(i, b"") for i in a], [self.b_bytes[i] for i in b]
            if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
                out.append(None)
                continue
            ends, i, j, x, y = [], 0, 0, 0, 0
            while i < len(a):
                if x <= y:
                    x += len(a_parts[i])
                    i += 1
                while y < x:
                    y += len(b_parts[j])
                    j += 1
                if x == y:
                    ends.append((i, j))
            out.append((a, b, ends))
        return out


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Loaded once a process; executors find public files at their own path."""
    key = (a_path, b_path)
    if key not in _loaded:
        _loaded[key] = Vocabularies(a_path, b_path)
    return _loaded[key]


def squeeze(ids: np.ndarray) -> bytes:
    """Numbers, frequent ones small, as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def spread(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<u4")


class Numbers(dict):
    """Numbers by order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def cut_blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to rows of documents (block, doc_id, numbers) and of a block's segments (block, segment, number, n)."""
    from pyspark import TaskContext

    vocab, done = vocabularies(a_path, b_path), count()

    def flush() -> Iterator[pa.RecordBatch]:
        # one attempt of a partition is committed, so its blocks are its own
        block = TaskContext.get().partitionId() << 32 | next(done)
        flat = np.concatenate(told) if told else np.zeros(0, np.int64)
        counts = np.bincount(flat, minlength=len(numbers))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        names = list(numbers)
        coded = [None if k is None else squeeze(rank[told[k]]) for k in places]
        for at in range(0, len(ids), ROWS):
            part = coded[at : at + ROWS]
            yield row_batch(schema, len(part), block=[block] * len(part), doc_id=pa.array(ids[at : at + ROWS], schema.field("doc_id").type), numbers=part)
        for at in range(0, len(order), ROWS):
            part = order[at : at + ROWS]
            yield row_batch(schema, len(part), block=[block] * len(part), segment=[names[i] for i in part], number=range(at, at + len(part)), n=counts[part])

    ids, places, told, numbers, held = [], [], [], Numbers(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if held and held + len(text or "") > most:
                yield from flush()
                ids, places, told, numbers, held = [], [], [], Numbers(), 0
            ids.append(doc_id)
            if text:
                places.append(len(told))
                told.append(np.fromiter(map(numbers.__getitem__, vocab.cut(text)), np.int64))
                held += len(text)
            else:
                places.append(None)
    if ids:
        yield from flush()


def row_batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


DEALT = pa.schema([("block", pa.int64()), ("pack", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def written(found: tuple[list[int], list[int], list[tuple[int, int]]] | None) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``; empty where the bytes differ."""
    if found is None:
        return ""
    a, b, ends = found
    return ";".join(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}" for (i, j), (k, m) in zip([(0, 0), *ends], ends))


def pairs_of(found: tuple[list[int], list[int], list[tuple[int, int]]] | None) -> list[int]:
    """The links: A's and B's id as one number."""
    return [] if found is None else [found[0][i - 1] << 32 | found[1][j - 1] for i, j in found[2]]


def align_sorted(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """(segment, block, number, n) rows, equal segments side by side, to DEALT rows: for each block that holds them groups
    by number, compressed, and the pairs of ids among them; at the end all pairs with their counts, without a block."""
    import zstandard

    vocab = vocabularies(a_path, b_path)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    total: Counter[int] = Counter()
    waiting: dict[int, list] = {}
    rows, last, kept = 0, None, None

    def flush() -> pa.RecordBatch:
        blocks = sorted(waiting)
        packs = [squeeze("\n".join(f"{number} {groups}" for number, groups, _ in waiting[b]).encode()) for b in blocks]
        pairs = [sorted({x for _, _, found in waiting[b] for x in found}) for b in blocks]
        return row_batch(DEALT, len(blocks), block=blocks, pack=packs, pairs=pairs)

    for batch in batches:
        segments = batch.column("segment").to_pylist()
        new = [x for x in dict.fromkeys(segments) if x != last]
        found = {x: (written(f), pairs_of(f)) for x, f in zip(new, vocab.align(new))}
        if last is not None:
            found[last] = kept
        for segment, block, number, n in zip(segments, *[batch.column(c).to_pylist() for c in ("block", "number", "n")]):
            groups, pairs = found[segment]
            waiting.setdefault(block, []).append((number, groups, pairs))
            for pair in pairs:
                total[pair] += n
        if segments:
            last, kept = segments[-1], found[segments[-1]]
        rows += len(segments)
        if rows >= PACKED:
            yield flush()
            waiting, rows = {}, 0
    if waiting:
        yield flush()
    found = sorted(total.items())
    for at in range(0, len(found), ROWS):
        part = found[at : at + ROWS]
        yield row_batch(DEALT, 1, pairs=[[p for p, _ in part]], counts=[[n for _, n in part]])


COUNTED = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def compose(texts: pa.Table, dealt: pa.Table) -> pa.Table:
    """A block's documents from the groups of its segments and the counts of its pairs."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at = dealt.column("pair").is_valid()
    known = dealt.filter(at)
    counts = {p: (b, c) for p, b, c in zip(*[known.column(c).to_pylist() for c in ("pair", "best", "count")])}
    lines = [line for p in dealt.column("pack").drop_null() for line in unpack(p.as_py()).decode().split("\n")]
    groups = [""] * len(lines)
    for line in lines:
        number, _, said = line.partition(" ")
        groups[int(number)] = said
    # every group's numbers once a block, then summed by segment
    parts = Numbers()
    sizes = np.array([g.count(";") + 1 if g else 0 for g in groups], dtype=np.int64)
    flat = np.fromiter((parts[x] for g in groups if g for x in g.split(";")), np.int64, count=int(sizes.sum()))
    values = np.zeros((len(parts), len(COUNTED)), dtype=np.int64)
    for part, i in parts.items():
        a, _, b = part.partition("|")
        a, b = a.split(","), b.split(",")
        values[i] = (len(a), len(b), 1, *counts[int(a[-1]) << 32 | int(b[-1])])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    running = np.concatenate([np.zeros((1, len(COUNTED)), np.int64), np.cumsum(values[flat], axis=0)])
    sums = running[ends[1:]] - running[ends[:-1]]
    rows, said = np.zeros((len(texts), len(COUNTED)), np.int64), []
    for k, data in enumerate(texts.column("numbers")):
        data = data.as_py()
        ids = np.zeros(0, np.int64) if data is None else spread(data)
        if not len(ids) or not sizes[ids].all():
            said.append("")
            continue
        rows[k] = sums[ids].sum(axis=0)
        said.append(";".join(map(groups.__getitem__, ids.tolist())))
    return pa.table([texts.column("doc_id"), *[pa.array(rows[:, i], pa.int64()) for i in range(len(COUNTED))], pa.array(said, pa.string())], names=["doc_id", *COUNTED, "groups"])


def align(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``) for every row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

    slim = docs.select("doc_id", "text")
    doc_id = slim.schema["doc_id"].dataType
    cut = StructType([StructField("block", LongType()), StructField("doc_id", doc_id), StructField("numbers", BinaryType()), StructField("segment", StringType()), StructField("number", IntegerType()), StructField("n", LongType())])
    arrow = to_arrow_schema(cut)
    blocks = stash(slim.mapInArrow(lambda batches: cut_blocks(batches, a_path, b_path, arrow, block), cut), "blocks")
    texts = blocks.where(F.col("segment").isNull()).select(F.col("block").alias("_of"), "doc_id", "numbers")
    parts = blocks.where(F.col("segment").isNotNull()).select("segment", "block", "number", "n")

    dealt = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(lambda batches: align_sorted(batches, a_path, b_path), "block long, pack binary, pairs array<long>, counts array<long>")
    dealt = stash(dealt, "dealt")
    # how many links hold a pair of ids, and whether no pair of its B id is held by more
    counted = dealt.where("block IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    counted = stash(counted.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    tops = counted.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("top"))
    ranked = counted.join(tops, F.col("b") == F.col("_b")).select(F.col("pair").alias("_pair"), (F.col("count") == F.col("top")).cast("long").alias("best"), "count")

    held = dealt.where("block IS NOT NULL")
    # a block's pairs, each once before they become rows; no more than the links of its distinct segments
    own = held.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    own = own.select("block", F.explode("pairs").alias("pair")).join(ranked, F.col("pair") == F.col("_pair")).select("block", F.lit(None).cast("binary").alias("pack"), "pair", "best", "count")
    none = F.lit(None).cast("long")
    back = held.select("block", "pack", none.alias("pair"), none.alias("best"), none.alias("count")).unionByName(own)
    out = StructType([StructField("doc_id", doc_id), *[StructField(c, LongType()) for c in COUNTED], StructField("groups", StringType())])
    composed = texts.groupBy("_of").cogroup(back.groupBy("block")).applyInArrow(lambda left, right: compose(left, right), out)
    return composed.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
