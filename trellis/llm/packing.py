"""Packing documents into sequences by linear grouping and best fit.

Tokens. Every whole text is encoded, an end token added, and only documents longer than a sequence are cut,
from the back: all pieces but the first fill a sequence. A piece of full length is a sequence of its own.

Plan. What is left to pack has fewer distinct lengths than a sequence has tokens, so it is planned on the
driver from the histogram of lengths alone (``capacity`` counts, whatever the number of documents):

1. Large lengths are cut into at most ``GROUPS`` groups of equal cardinality, and each is rounded up to its
   group's greatest.
2. Over these few sizes the configurations of a sequence are optimised: a linear programme over patterns,
   solved by column generation with a knapsack as pricing; its solution is rounded down.
3. Actual documents replace the rounded sizes, which frees what rounding up had wasted. Every configured
   sequence is kept.
4. Small documents, and what rounding the programme down has left, go, longest first, to the sequence with the
   least room that holds them; full runs of equal sequences are filled at once. New sequences open when none has room.

What counts as large decides how much is configured and how much is fitted. The plan is made for each share of a
sequence in ``LARGE``, until one is near the least possible number, and the one with the fewest sequences is used: where lengths are diverse that is one half
(a large document heads each configuration and rounding wastes nothing), with few distinct lengths a lower one.

A plan row says: of the pieces with this length, those ranked [first, last) go ``each`` to a sequence,
starting at this sequence and offset. The rows are bounded by lengths and patterns, not by documents.

Ranks. Tasks number their own pieces of each length; the counts of (task, length) add up to offsets. So
equal lengths never gather, however many documents share one.

Defined cases: null text: as empty, one piece holding the end token; repeated rows: packed each; null
doc_id: kept; empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, text_of

CAPACITY, END_ID, GROUPS = 1024, 2, 80
#: Shares of a sequence above which a length is large.
LARGE = (1 / 2, 1 / 3, 1 / 5, 1 / 8)
#: Above the least possible number of sequences by this share (and two) another share of LARGE is tried.
NEAR = 0.001
_loaded: dict = {}


def encoder(path: str):
    if path not in _loaded:
        from .tokens import ByteBpe

        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 500) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times): how often each pattern (a number for every size) is used, rounded down."""
    n = len(sizes)
    patterns = [[capacity // s if i == k else 0 for i in range(n)] for k, s in enumerate(sizes)]
    basis = np.array(patterns, float).T
    need, at_size = np.array(counts, float), np.array(sizes)
    by_size = np.argsort(at_size, kind="stable")
    ordered = at_size[by_size].tolist()
    for _ in range(rounds):
        try:
            use, price = np.linalg.solve(basis, need), np.linalg.solve(basis.T, np.ones(n))
        except np.linalg.LinAlgError:
            break
        # the pattern of greatest value: an unbounded knapsack over the capacity
        value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            fit = by_size[: bisect_right(ordered, room)]
            if len(fit):
                worth = value[room - at_size[fit]] + price[fit]
                k = int(worth.argmax())
                value[room], took[room] = (worth[k], fit[k]) if worth[k] > value[room - 1] + 1e-12 else (value[room - 1], -1)
        if value[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                column[took[room]] += 1
                room -= sizes[took[room]]
        step = np.linalg.solve(basis, column)
        ratio = [(use[i] / step[i], i) for i in range(n) if step[i] > 1e-9]
        if not ratio:
            break
        basis[:, min(ratio)[1]] = column
    use = np.linalg.solve(basis, need)
    return [(tuple(int(x) for x in basis[:, i]), int(use[i] + 1e-7)) for i in range(n) if use[i] >= 1 - 1e-7]


Row = tuple[int, int, int, int, int, int]


def grouped(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[list[int], list[list], list]:
    """Rounded sizes, the actual (length, count) runs behind each, and the patterns over the sizes."""
    # 1. equal cardinality groups of the large lengths, the longest first
    long_ = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if capacity * large < x < capacity and histogram[x]]
    total = sum(c for _, c in long_)
    sizes, members, left = [], [], 0
    for x, c in long_:
        while c:
            if not left:
                sizes.append(x)
                members.append([])
                left = -(-total // groups)
            take = min(c, left)
            members[-1].append([x, take])
            c, left = c - take, left - take
    counts = [sum(c for _, c in m) for m in members]
    # 2. patterns over the rounded sizes. Equal sizes may head several groups: they share one
    merged: dict[int, list] = {}
    for s, m in zip(sizes, members):
        merged.setdefault(s, []).extend(m)
    sizes, members = list(merged), list(merged.values())
    counts = [sum(c for _, c in m) for m in members]
    patterns = configurations(sizes, counts, capacity) if sizes else []
    return sizes, members, patterns


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> tuple[list[Row], int]:
    """(length, first, last, each, sequence, offset) rows and the number of sequences. Lengths are 1..capacity."""
    bound, found = -(-sum(x * n for x, n in histogram.items()) // capacity), None
    for share in large:
        new = placed(histogram, capacity, *grouped(histogram, capacity, groups, share))
        found = new if found is None or new[1] < found[1] else found
        if found[1] - bound <= max(2, NEAR * bound):
            break
    return found


def placed(histogram: dict[int, int], capacity: int, sizes: list[int], runs_of: list[list], patterns: list) -> tuple[list[Row], int]:
    rows: list[Row] = []
    used = Counter()  # pieces of each length that have a place
    opened = 0
    #: runs of equal sequences by the room they have left: room -> [(first sequence, how many)]
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def place(length: int, each: int, first: int, times: int, room: int) -> None:
        """``each`` pieces of a length into every one of ``times`` sequences that have ``room`` left."""
        rows.append((length, used[length], used[length] + each * times, each, first, capacity - room))
        used[length] += each * times

    if full := histogram.get(capacity, 0):
        place(capacity, 1, 0, full, capacity)
        opened = full
    members = [[list(x) for x in m] for m in runs_of]
    counts = [sum(c for _, c in m) for m in members]
    rest = counts[:]
    for pattern, times in patterns:
        for k, per in enumerate(pattern):
            if per:
                times = min(times, rest[k] // per)
        slots = [k for k, per in enumerate(pattern) for _ in range(per)]
        for k, per in enumerate(pattern):
            rest[k] -= per * times
        # 3. actual lengths: cut the run wherever one of the slots' supplies goes over to another length
        while times:
            now, run = [], times
            ahead: dict[int, list] = {k: [list(x) for x in members[k]] for k in set(slots)}
            share = Counter(slots)
            for k in set(slots):
                # pieces of one group lie side by side: as many as share a length, the others one by one
                head = ahead[k][0]
                per = share[k]
                if head[1] >= per:
                    run = min(run, head[1] // per)
                    now.append((head[0], per))
                else:
                    run = 1
                    for x, c in ahead[k]:
                        take = min(c, per)
                        if take:
                            now.append((x, take))
                        per -= take
                        if not per:
                            break
            for k in set(slots):
                want = share[k] * run
                while want:
                    take = min(want, members[k][0][1])
                    members[k][0][1] -= take
                    want -= take
                    if not members[k][0][1]:
                        members[k].pop(0)
            room = capacity
            for x, per in now:
                place(x, per, opened, run, room)
                room -= x * per
            rooms[room].append((opened, run))
            opened += run
            times -= run
    # 4. everything that has no place yet, longest first, by best fit
    for length in range(capacity - 1, 0, -1):
        n = histogram.get(length, 0) - used[length]
        open_rooms = sorted(r for r in rooms if r >= length and rooms[r])
        at = bisect_left(open_rooms, length)
        while n and at < len(open_rooms):
            room = open_rooms[at]
            runs, rooms[room] = rooms[room], []
            each = room // length
            for k, (first, times) in enumerate(runs):
                whole = min(times, n // each)
                if whole:
                    place(length, each, first, whole, room)
                    rooms[room - each * length].append((first, whole))
                    n -= whole * each
                if whole < times and n:
                    place(length, n, first + whole, 1, room)
                    rooms[room - n * length].append((first + whole, 1))
                    whole, n = whole + 1, 0
                if whole < times:
                    rooms[room].append((first + whole, times - whole))
                if not n:
                    rooms[room].extend(runs[k + 1 :])
                    break
            at += 1
        if n:
            each = capacity // length
            whole = n // each
            if whole:
                place(length, each, opened, whole, capacity)
                rooms[capacity - each * length].append((opened, whole))
                opened += whole
            if n % each:
                place(length, n % each, opened, 1, capacity)
                rooms[capacity - n % each * length].append((opened, 1))
                opened += 1
    return rows, opened


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _task, _rank (of the length in the task), stashed."""
    texts = docs.select("doc_id", text_of().alias("_t"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, seen = encoder(path).ids, np.array([end_id], "<u4").tobytes(), Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("_t")):
                ids = memoryview(ids_of(text.as_py()) + end)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if not piece else capacity
                    at.append(i)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))), pa.array([task] * len(at), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_task"])

    return stash(texts.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _rank long, _task int"), "pieces")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    cut = pieces(docs, path, capacity, end_id)
    spark = docs.sparkSession
    counts = cut.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = stash(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    histogram = {r[0]: r[1] for r in offsets.groupBy("length").agg(F.sum("_n")).collect()}  # at most one row a length
    rows, _ = plan(histogram, capacity)
    if not rows:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # per length: sorted firsts with what belongs to them; found by position, inside the row
    by: dict[int, list] = defaultdict(list)
    for length, first, _, each, sequence, offset in sorted(rows):
        by[length].append((first, each, sequence, offset))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {x: np.array(v, np.int64) for x, v in by.items()}
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                x = int(length[own[0]])
                t = tables[x]
                k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                nth = rank[own] - t[k, 0]
                sequence[own], offset[own] = t[k, 2] + nth // t[k, 1], t[k, 3] + nth % t[k, 1] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # offsets grow with the tasks, so they are dealt by key and not sent to all
    ranked = cut.join(offsets.drop("_n").hint("shuffle_hash"), ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(seat, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
