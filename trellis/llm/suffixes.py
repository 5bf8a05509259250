"""Exact substring deduplication by a distributed merge sort of suffixes.

Every byte that lies in a string of ``length`` bytes (``LENGTH`` unless given) which also starts somewhere
else is removed. Where ``words`` is given, a maximal run of such bytes goes only if it has LENGTH bytes or
that many words. Where ``passage`` is given, a length below the first, runs of strings of that length that
also start elsewhere are found in the same pass and counted if they have LENGTH bytes or ``PASSAGE_WORDS``
words; nothing is removed for them.

1. Suffixes. Only suffixes at anchors are sorted. A window (length bytes, of the least length asked for) has
   as its anchor the start of the
   least-hashing ``gram``-byte string inside it (the first of equal ones), which equal windows share at the
   same place. So each window belongs to one suffix, and about one position in 150 is one (in 70 at 200 bytes).
2. Two equal windows need equal anchor strings; suffixes whose anchor string occurs once are left out, by
   counting 64-bit hashes (a collision only keeps one more).
3. A suffix is written as the bytes from its anchor on, as far as windows of the greatest length reach,
   followed by the bytes before it, backwards. Tasks sort theirs into runs, front-code them (length of the prefix shared with the
   entry before, then the rest; equal entries once, with a count) and deal them out by anchor string.
4. A task merges the runs of its part with a loser tree whose matches start behind the prefix that both
   contenders are known to share with the last winner. It hands on each suffix with the length of the
   prefix that it shares with its predecessor; suffixes of one anchor string come side by side.
5. Among these, a window is repeated where another suffix agrees for all of its bytes from the anchor on
   (the least shared prefix in between) and before it. That gives each distinct suffix the one range
   that it loses, and occurrences get it by the suffix's digest.

An anchor string with more than ``HOT`` occurrences (a line in a third of all documents) would meet in one
task: its suffixes go another exact way, in which their windows' digests are counted as rows.

Defined cases: null or empty text: nothing to remove, and a null text stays null in ``dedup_documents``;
texts under the length: nothing; equal rows repeat each other (if long enough all their bytes go); null
doc_id: kept; long texts are worked through in pieces of ``PIECE`` windows; empty table: no rows. Further
columns may have any names: ``dedup_documents`` returns them all, ``without_repeats`` those that are not
named like one of its results.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

LENGTH, GRAM, HOT = 400, 64, 20_000
#: What counts as a passage where a second length is asked for.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Keys that a repeated window of crowded suffixes is spread over.
SALTS = 32
PIECE = 1 << 18
#: A task sorts and deals out its runs whenever they hold this many bytes.
RUN_BYTES = 24 << 20
#: Bytes of text for each part of the merge.
PART_BYTES = 12 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict = {}


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


CODES = _byte_codes()


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes: differences of prefix sums over powers of an odd base."""
    n = len(data)
    if _powers.get("n", 0) < n + 1:
        size = max(n + 1, 2 * _powers.get("n", 0))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, x in (("up", BASE), ("down", inverse)):
            steps = np.full(size, x)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
        _powers["n"] = size
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * _powers["down"][:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _powers["up"][: n - gram + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, ends: list[int], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) arrays for texts joined in ``data``, which stop at ``ends``."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    wide = length - gram + 1
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    least, size = hashes, 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[wide - size : wide - size + n])
    inside = np.zeros(n + 1, np.int8)
    start = 0
    for end in ends:
        if end - start >= length:
            inside[start] += 1
            inside[end - length + 1] -= 1
        start = end
    inside = np.cumsum(inside[:n]).astype(bool)
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    cut = np.flatnonzero(fresh)
    first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
    # a text's end may touch the next one's start: no run reaches over it
    found = []
    while len(first):
        place = np.concatenate([hashes[f[:, None] + np.arange(wide)].argmin(axis=1) + f for f in np.array_split(first, len(first) // 2048 + 1)])
        found.append((hashes[place], place, first, np.minimum(last, place)))
        more = place < last  # a later equal minimum is the anchor of the windows behind this one
        first, last = place[more] + 1, last[more]
    return tuple(np.concatenate(x) for x in zip(*found))


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(_key, _t) batches to one row for each suffix."""

    def found(held: list, ends: list[int], joined: bytes) -> pa.RecordBatch:
        hashes, place, first, last = anchors(joined, ends, length, gram)
        which = np.searchsorted(ends, place, side="right")
        shift = np.array([base - (ends[i - 1] if i else 0) for i, (_, base) in enumerate(held)], np.int64)[which]
        keys = pa.array([k for k, _ in held], pa.binary()).take(pa.array(which))
        return pa.RecordBatch.from_arrays([keys, pa.array(hashes.view(np.int64)), *(pa.array(x + shift) for x in (place, first, last))], ["_key", "hash", "place", "first", "last"])

    held, ends, joined = [], [], bytearray()
    for batch in batches:
        for key, text in zip(batch.column("_key"), batch.column("_t")):
            data = text.as_py() or b""
            for at in range(0, len(data) - length + 1, PIECE):
                joined += data[at : at + PIECE + length - 1]
                held.append((key.as_py(), at))
                ends.append(len(joined))
                if len(joined) >= PIECE:
                    yield found(held, ends, bytes(joined))
                    held, ends, joined = [], [], bytearray()
    if held:
        yield found(held, ends, bytes(joined))


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``at`` bytes."""
    n = min(len(a), len(b))
    while at < n:
        stop = min(at + 64, n)
        x, y = a[at:stop], b[at:stop]
        if x != y:
            bits = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + (stop - at) - (bits.bit_length() + 7) // 8
        at = stop
    return n


def shape_of(ahead: int, low: int) -> int:
    """How a suffix is to be read: ``ahead`` bytes from the anchor on; its last window starts ``low`` before it."""
    return low << 16 | ahead


def ahead_low(shape: int) -> tuple[int, int]:
    return shape & 0xFFFF, shape >> 16


def front_coded(entries: list[tuple[bytes, int, int]]) -> bytes:
    """A sorted run of (string, shape, count) as bytes."""
    out, tails, before = [], [], b""
    for text, shape, count in entries:
        shared = shared_prefix(before, text, 0)
        out.append((shared, len(text) - shared, shape, count))
        tails.append(text[shared:])
        before = text
    import zstandard

    return struct.pack("<I", len(entries)) + zstandard.ZstdCompressor(level=1).compress(np.array(out, "<u4").tobytes() + b"".join(tails))


class Run:
    """Reads a front-coded run; ``shared`` is the prefix its entry shares with the last one handed out."""

    def __init__(self, data: bytes):
        import zstandard

        n = struct.unpack("<I", data[:4])[0]
        self.data = zstandard.ZstdDecompressor().decompress(data[4:])
        self.rows = np.frombuffer(self.data, "<u4", 4 * n).reshape(n, 4).tolist()
        self.next, self.at, self.text, self.shared = 0, 16 * n, b"", 0

    def advance(self) -> bool:
        if self.next >= len(self.rows):
            self.text, self.data, self.rows = None, b"", []
            return False
        self.shared, rest, self.shape, self.count = self.rows[self.next]
        self.text = self.text[: self.shared] + self.data[self.at : self.at + rest]
        self.at += rest
        self.next += 1
        return True


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, shape, count, prefix shared with the one before) of all runs in order, equal ones once.

    A loser tree: every inner node holds the contender that lost there, with the prefix that it shares with
    the one that beat it. On the winner's way up all of these relate to the last winner, so the longer shared
    prefix wins unseen; only if they are equal are bytes compared, from there on.
    """
    runs = [r for r in runs if r.advance()]
    if not runs:
        return
    size = 1
    while size < len(runs):
        size *= 2
    losers: list[Run | None] = [None] * size

    def match(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser)."""
        if a is None or b is None or a.text is None or b.text is None:
            return (b, a) if a is None or a.text is None else (a, b)
        if a.shared != b.shared:
            return (a, b) if a.shared > b.shared else (b, a)
        x, y = a.text, b.text
        n = shared_prefix(x, y, a.shared)
        if n < len(x) and n < len(y):
            won = x[n] < y[n]
        else:
            won = (len(x), a.shape) <= (len(y), b.shape)
        if won:
            b.shared = n
            return a, b
        a.shared = n
        return b, a

    def build(node: int) -> Run | None:
        if node >= size:
            return runs[node - size] if node - size < len(runs) else None
        winner, losers[node] = match(build(2 * node), build(2 * node + 1))
        return winner

    for k, run in enumerate(runs):
        run.leaf = size + k
    winner = build(1)
    held = None
    while winner is not None and winner.text is not None:
        if held and winner.shared == len(held[0]) == len(winner.text) and held[1] == winner.shape:
            held[2] += winner.count
        else:
            if held:
                yield tuple(held)
            held = [winner.text, winner.shape, winner.count, winner.shared]
        winner.advance()
        node = winner.leaf // 2
        while node:
            winner, losers[node] = match(winner, losers[node])
            node //= 2
    yield tuple(held)


def repeated(group: list[tuple[bytes, int, int, int]], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(place in the group, from, to) for the suffixes of one anchor string, in order: the bytes, relative to
    the anchor, that repeated windows cover. They are one range, as every window holds the anchor. The window
    of offset k starts k bytes before the anchor."""
    aheads, lows = zip(*(ahead_low(shape) for _, shape, _, _ in group))
    backs = [text[ahead:] for (text, _, _, _), ahead in zip(group, aheads)]
    spans = [(max(low, length - ahead), len(back)) for ahead, low, back in zip(aheads, lows, backs)]
    if len(group) == 2 and group[0][2] == group[1][2] == 1:
        ahead = min(group[1][3], *aheads)
        behind = shared_prefix(*backs, 0)
        a, b = max(length - ahead, spans[0][0], spans[1][0]), min(behind, spans[0][1], spans[1][1])
        if a <= b:
            yield from ((i, -b, length - a) for i in (0, 1))
        return
    # least and greatest offset of a repeated window; a suffix that occurs twice loses all of its windows
    hits: list[tuple[int, int] | None] = [span if entry[2] > 1 and span[0] <= span[1] else None for entry, span in zip(group, spans)]
    if len(group) > 1 and any(not hit and a <= b for hit, (a, b) in zip(hits, spans)):
        for k in range(min(a for a, _ in spans), max(b for _, b in spans) + 1):
            alike, part = defaultdict(list), 0
            for i, (a, b) in enumerate(spans):
                if i and group[i][3] < length - k:
                    part += 1
                if a <= k <= b:
                    alike[part, backs[i][:k]].append(i)
            for those in alike.values():
                if len(those) > 1:
                    for i in those:
                        if group[i][2] == 1:
                            hits[i] = (hits[i][0] if hits[i] else k, k)
    yield from ((i, -hit[1], length - hit[0]) for i, hit in enumerate(hits) if hit)


def digest_of(text: bytes, shape: int) -> bytes:
    return hashlib.blake2b(text, digest_size=16, salt=struct.pack("<Q", shape)).digest()


SUFFIX = "kind int, part int, run binary, _key binary, place long, id binary, length int, k int, weight int"


def _sorted_runs(parts: int, hot: int, lengths: tuple[int, ...]):
    """(_t, _key, found) batches to: runs (kind 0), occurrences (kind 1), windows of hot suffixes (kind 2)."""
    names = [c.split()[0] for c in SUFFIX.split(", ")]
    kinds = {"kind": pa.int32(), "part": pa.int32(), "run": pa.binary(), "_key": pa.binary(), "place": pa.int64(), "id": pa.binary(), "length": pa.int32(), "k": pa.int32(), "weight": pa.int32()}

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = defaultdict(dict)  # part -> (string, shape) -> count
        crowded: dict[tuple, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, entries in held.items():
                run = front_coded([(text, shape, min(count, 2)) for (text, shape), count in sorted(entries.items())])
                yield rows(kind=[0], part=[part], run=[run])
            for (text, shape), count in crowded.items():
                ahead, low = ahead_low(shape)
                own, back = digest_of(text, shape), text[ahead:]
                for length in lengths:
                    ks = range(max(low, length - ahead), len(back) + 1)
                    windows = [hashlib.blake2b(back[:k][::-1] + text[: length - k], digest_size=16).digest() for k in ks]
                    yield rows(kind=[2] * len(windows), run=windows, id=[own] * len(windows), length=[length] * len(windows), k=list(ks), weight=[min(count, 2)] * len(windows))
            held.clear()
            crowded.clear()

        for batch in batches:
            keys, places, ids = [], [], []
            for text, key, found in zip(batch.column("_t"), batch.column("_key"), batch.column("found")):
                data, key = text.as_py(), key.as_py()
                for s in found.as_py():
                    place = s["place"]
                    ahead = data[place : s["last"] + max(lengths)]
                    whole, shape = ahead + data[s["first"] : place][::-1], shape_of(len(ahead), place - s["last"])
                    keys.append(key)
                    places.append(place)
                    ids.append(digest_of(whole, shape))
                    into = crowded if s["n"] > hot else held[s["hash"] % parts]
                    known = into.get((whole, shape), 0)
                    into[whole, shape] = known + 1
                    if not known:
                        size += len(whole)
                    if size >= RUN_BYTES:
                        yield from flush()
                        size = 0
            if ids:
                yield rows(kind=[1] * len(ids), _key=keys, place=places, id=ids)
        yield from flush()

    return work


def _merge(table: pa.Table, lengths: tuple[int, ...], gram: int) -> pa.Table:
    """All runs of one part to (id, length, from, to): what each distinct suffix loses, relative to its anchor."""
    ids, sizes, starts, stops, group = [], [], [], [], []

    def close() -> None:
        for length in lengths:
            for i, a, b in repeated(group, length):
                ids.append(digest_of(*group[i][:2]))
                sizes.append(length)
                starts.append(a)
                stops.append(b)

    for entry in merged([Run(r.as_py()) for r in table.column("run")]):
        if group and entry[3] < gram:
            if len(group) > 1 or group[0][2] > 1:
                close()
            group = []
        group.append(entry)
    if len(group) > 1 or group and group[0][2] > 1:
        close()
    return pa.table({"id": pa.array(ids, pa.binary()), "length": pa.array(sizes, pa.int32()), "from": pa.array(starts, pa.int32()), "to": pa.array(stops, pa.int32())})


def keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns but the text, as a struct), _key, _t (the text's bytes). The key is a digest of doc_id
    and text; rows that share it lose the same bytes."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(row.alias("_row"), key.alias("_key"), F.col("text").cast("binary").alias("_t"))


def lost_ranges(docs: DataFrame, hot: int = HOT, length: int = LENGTH, gram: int = GRAM, passage: int | None = None) -> DataFrame:
    """_key, ranges (array of length, from, to in bytes; they may overlap): only texts with repeated strings. Stashed."""
    lengths = tuple(dict.fromkeys([length, passage or length]))
    short = min(lengths)
    texts = keyed(docs.select("doc_id", "text")).select("_key", "_t")
    found = stash(texts.mapInArrow(lambda batches: _find(batches, short, gram), "_key binary, hash long, place long, first long, last long"), "anchors")
    twice = stash(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    near = found.join(twice, "hash").groupBy("_key").agg(F.collect_set(F.struct("place", "first", "last", "hash", "n")).alias("found"))
    near = stash(near, "near")
    parts = max(1, -(-docs.select(F.sum(F.octet_length("text"))).first()[0] // PART_BYTES)) if not near.isEmpty() else 1
    sorted_ = stash(texts.join(near.hint("shuffle_hash"), "_key").select("_t", "_key", "found").mapInArrow(_sorted_runs(parts, hot, lengths), SUFFIX), "runs")
    discard(found)
    discard(twice)
    discard(near)
    lost = sorted_.where("kind = 0").select("part", "run").repartition(parts, "part").groupBy("part").applyInArrow(lambda runs: _merge(runs, lengths, gram), "id binary, length int, `from` int, `to` int")
    windows = sorted_.where("kind = 2").select("run", "id", "length", "k", "weight", F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    # a window that very many suffixes share is one digest: it is met under SALTS keys
    again = windows.groupBy("run").agg(F.sum("weight").alias("n")).where("n > 1").select("run", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    crowded = windows.join(again, ["run", "salt"], "left_semi").groupBy("id", "length").agg((-F.max("k")).alias("from"), (F.col("length") - F.min("k")).alias("to"))
    lost = stash(lost.unionByName(crowded), "lost")
    places = sorted_.where("kind = 1").select("_key", "place", "id")
    ranges = places.join(lost, "id").select("_key", "length", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to")).distinct()
    out = stash(ranges.groupBy("_key").agg(F.collect_list(F.struct("length", "from", "to")).alias("ranges")), "ranges")
    discard(sorted_)
    discard(lost)
    return out


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: ranges that overlap or touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(length: int, passage: int, words: int, texts: bool):
    """(_row, _t, ranges) batches to (_row, _kept, n_bytes, n_removed, n_spans, n_passages)."""

    def long_enough(data: bytes, ranges: list[dict], of: int, least: int) -> list[tuple[int, int]]:
        runs = united([(r["from"], r["to"]) for r in ranges if r["length"] == of])
        return [(a, b) for a, b in runs if b - a >= LENGTH or len(data[a:b].split()) >= least]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for text, ranges in zip(batch.column("_t"), batch.column("ranges")):
                text, ranges = text.as_py(), ranges.as_py() or []
                data = text or b""
                runs = long_enough(data, ranges, length, words)
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                left = b"".join(parts)
                kept.append((None if text is None else left.decode("utf-8", "ignore")) if texts else left)
                counts.append((len(data), sum(b - a for a, b in runs), len(runs), len(long_enough(data, ranges, passage, PASSAGE_WORDS))))
            columns = list(zip(*counts)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string() if texts else pa.binary()), *(pa.array(x, pa.int64()) for x in columns)], ["_row", *RESULTS])

    return work


RESULTS = ("_kept", "n_bytes", "n_removed", "n_spans", "n_passages")


def measured(docs: DataFrame, hot: int, texts: bool, length: int, gram: int, words: int, passage: int | None) -> DataFrame:
    """_row (the other columns of every row of ``docs``) and RESULTS."""
    ranges = lost_ranges(docs, hot, length, gram, passage).withColumnRenamed("_key", "_k")
    rows = keyed(docs)
    joined = rows.join(ranges.hint("shuffle_hash"), rows["_key"] == ranges["_k"], "left").select("_row", "_t", "ranges")
    kind = joined.schema["_row"].dataType.simpleString()
    return joined.mapInArrow(_cut(length, passage or length, words, texts), f"_row {kind}, _kept {'string' if texts else 'binary'}, n_bytes long, n_removed long, n_spans long, n_passages long")


def without_repeats(docs: DataFrame, hot: int = HOT, texts: bool = False, length: int = LENGTH, gram: int = GRAM, words: int = 0, passage: int | None = None) -> DataFrame:
    """Every row of ``docs`` (but its text and columns named like a result) with _kept (the remaining bytes;
    ``texts``: as text), n_bytes, n_removed, n_spans and n_passages (runs of strings of ``passage`` bytes)."""
    out = measured(docs, hot, texts, length, gram, words, passage)
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "text" and c not in RESULTS], *RESULTS)


def dedup_documents(docs: DataFrame, hot: int = HOT, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """The documents with their repeated passages removed, n_chars anew; of a character that is cut in two
    nothing stays. A document of which nothing is left, or no word, goes; one that had no text before stays."""
    out = measured(docs, hot, True, length, gram, words, None)
    out = out.where((F.col("n_removed") == 0) | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda c: F.when(F.col("n_removed") > 0, F.length("_kept")).otherwise(F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType)
    return out.select(*[(F.col("_kept") if c == "text" else chars(c) if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
