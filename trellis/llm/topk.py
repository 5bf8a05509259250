"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Index. Vectors (components floored to whole numbers after scaling) are cut into blocks of ``BLOCK`` rows of one
length. In a block every dimension's members are sorted by value and cut into at most ``LEVELS`` impact levels of
about equal membership; a level of a dimension is one posting segment: its members and its least and greatest
value. Every row is indexed, and nothing is fitted.

Search. A segment's quantised impact for a query is the greatest product that its values can give, above the least
that its dimension can. Segments are processed by descending impact: each adds its impact to the accumulators of
its members. After every share of the postings (``SHARES``) the search looks for its proof. A member's score is
at most what it has gathered and, for each dimension in which it has not been met, the greatest impact still
open there; the sum of as many of these, the greatest first, as it has dimensions left is taken. The members
that could lead are scored exactly, and the k-th best score known is the bar. Members whose bound is below the bar
are proved out; once no more than ``FEW`` are left, or all segments are processed, these are scored exactly.
So the answer is exact wherever the search stops. Sums stay below ``EXACT``, or else every member is scored.

Queries go in blocks too: the pairs of blocks are the tasks, and only k rows a query leave each. The first bar of
a query is its k-th score in one bounded sample of the rows (``SAMPLE``). Which side of the pairs is broadcast, if
any, is left to the planner, which knows the size of both tables; beyond its threshold pairs are made by parts.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor rows
with a null id, nor vectors whose scaled components leave the range of a long; a query meets only vectors of its
own length; repeated ids are rows of their own, and a query row that is repeated gets an answer for each row, but
a query never meets rows of its own id; equal scores: smaller id first; an empty table: no rows. A score beyond
the range of a long raises OverflowError. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

BLOCK, QUERY_BLOCK, LEVELS, SAMPLE = 8192, 512, 64, 4096
#: Shares of a block's postings after which a search looks for its proof; after the last, all are processed.
SHARES = (0.5, 0.75, 0.9, 1.0)
#: A search stops early once no more of a block's members than this are possible.
FEW = 64
#: An accumulator holds a sum of impacts below EXACT and, above it, how often the member has been met; whole numbers
#: below 2**53 are exact there. Below LONG sums of longs are.
EXACT, LONG = 1 << 40, 1 << 62


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) as whole numbers, of the vectors that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 63)))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(sound).select("vec_id", v.alias("v"))


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """block, ids, vals (row after row), wide (64-bit values, else 32), dims: one row a block of at most ``rows`` vectors of one length."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, same in frame.groupby(frame["v"].map(len), sort=True):
                for at in range(0, len(same), rows):
                    part = same.iloc[at : at + rows]
                    values = np.stack(part["v"].to_numpy())
                    wide = bool(np.abs(values.astype(float)).max() >= 1 << 31)
                    yield pd.DataFrame({"ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vals": [values.astype("<i8" if wide else "<i4").tobytes()], "wide": [wide], "dims": [dims]})

    out = vectors.mapInPandas(pack, "ids binary, vals binary, wide boolean, dims int")
    return stash(out.withColumn("block", F.monotonically_increasing_id()), name)


def exact_scores(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products row by row, whatever their size."""
    reach = int(np.abs(values.astype(float)).max(initial=0)) * int(np.abs(queries.astype(float)).max(initial=0)) * max(1, values.shape[1])
    if reach < LONG:
        return np.einsum("ij,ij->i", values.astype(np.int64), queries.astype(np.int64))
    sums = [sum(int(a) * int(b) for a, b in zip(v, q)) for v, q in zip(values, queries)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in sums):
        raise OverflowError("a score leaves the range of a long")
    return np.array(sums, np.int64)


class Block:
    """The postings of one block: for every dimension its members by value, cut into segments."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS):
        self.ids, self.values = ids, values
        n, self.dims = values.shape
        self.levels = levels = min(levels, n)
        #: member[d] are the members of dimension d by value; segment s of it is [cuts[s], cuts[s + 1])
        self.member = np.argsort(values, axis=0, kind="stable").T.copy()
        self.cuts = (np.arange(levels + 1) * n) // levels
        self.sizes = np.diff(self.cuts)
        ordered = np.take_along_axis(values.T, self.member, axis=1)
        self.low, self.high = ordered[:, self.cuts[:-1]].astype(np.int64), ordered[:, self.cuts[1:] - 1].astype(np.int64)

    def impacts(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Of every (dimension, segment) the impact above the dimension's least, and the sum of these."""
        wide = query.astype(np.int64)[:, None]
        impact = np.where(wide >= 0, wide * self.high, wide * self.low)
        least = impact.min(axis=1)
        return impact - least[:, None], int(least.sum())

    def walk(self, impact: np.ndarray, upward: np.ndarray, shares: tuple):
        """Processes segments by descending impact; after each share yields (share, gathered, bound of what is open
        by the number of dimensions in which a member has been met, that number).

        ``upward``: dimensions whose impact grows with the value; there segments come from the last to the first,
        elsewhere from the first on, so that what has come of a dimension is always one stretch of its postings."""
        n, levels = len(self.ids), self.levels
        held = np.zeros(n)
        turned = np.where(upward[:, None], impact[:, ::-1], impact)  # descending in each dimension
        order = np.argsort(-turned.ravel(), kind="stable")
        sizes = np.where(upward[:, None], self.sizes[::-1], self.sizes).ravel()
        postings = np.cumsum(sizes[order])
        before = np.zeros(self.dims, np.int64)
        for share in shares:
            upto = len(order) if share >= 1 else int(np.searchsorted(postings, share * postings[-1], side="right"))
            done = np.bincount(order[:upto] // levels, minlength=self.dims)
            members, weights = [], []
            for d in np.flatnonzero(done > before):
                first, last = (levels - done[d], levels - before[d]) if upward[d] else (before[d], done[d])
                members.append(self.member[d, self.cuts[first] : self.cuts[last]])
                weights.append(np.repeat(impact[d, first:last], self.sizes[first:last]))
            if members:
                members = np.concatenate(members)
                held += np.bincount(members, weights=np.concatenate(weights) + EXACT, minlength=n)
            before = done
            left = np.where(done < levels, turned[np.arange(self.dims), np.minimum(done, levels - 1)], 0)
            met = (held // EXACT).astype(np.int64)
            yield share, held - met * float(EXACT), np.concatenate([[0], np.cumsum(np.sort(left)[::-1])])[::-1], met

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, shares: tuple = SHARES, few: int = FEW, stops: list | None = None):
        """(query row, member, score) of all that may be among the k best of each query, scores exact.

        ``own``: the queries' ids, which are no candidates of theirs; ``floor``: a score that each query's
        k-th best reaches for certain (or minus infinity); ``stops`` gets the share at which each search ended."""
        reach = int(np.abs(self.values.astype(float)).max(initial=0)) * int(np.abs(queries.astype(float)).max(initial=0)) * self.dims
        found = []
        for q in range(len(queries)):
            possible = np.flatnonzero(self.ids != own[q])
            if 4 * reach < EXACT and self.dims < 4096 and len(possible) > few:
                bar, others = floor[q], possible
                impact, least = self.impacts(queries[q])
                for share, gathered, open_, met in self.walk(impact, queries[q] >= 0, shares):
                    at_most = least + gathered[others] + open_[met[others]]
                    if len(others) > k:
                        lead = others[np.argpartition(-at_most, k - 1)[:k]]
                        bar = max(bar, (self.values[lead].astype(np.int64) @ queries[q].astype(np.int64)).min())
                    possible = others[at_most >= bar]
                    if len(possible) <= few:
                        break
                if stops is not None:
                    stops.append(share)
            found.append((np.full(len(possible), q), possible))
        query, member = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        return query, member, exact_scores(self.values[member], queries[query])


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score down and id up."""
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _decoded(ids: bytes, vals: bytes, wide: bool, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vals, "<i8" if wide else "<i4").reshape(-1, dims)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: rows of the same columns, in blocks against all rows."""
    spark = vectors.sparkSession
    index = packed(quantised(vectors, scale), BLOCK, "index")
    asked = packed(quantised(queries, scale), QUERY_BLOCK, "queries")
    sample = index.orderBy("block").limit(1).select("ids", "vals", "wide", "dims").first()
    if sample is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first_ids, first = (x[:SAMPLE] for x in _decoded(*sample))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, None)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if held[0] != row.block:
                    held = (row.block, Block(*_decoded(row.ids, row.vals, row.wide, row.dims)))
                own, q = _decoded(row.q_ids, row.q_vals, row.q_wide, row.dims)
                floor = np.full(len(own), -np.inf)
                if row.dims == first.shape[1] and len(first) > k and float(np.abs(first).max()) * float(np.abs(q).max()) * row.dims < EXACT:
                    seen = q.astype(np.float64) @ first.T.astype(np.float64)
                    seen[own[:, None] == first_ids[None, :]] = -np.inf
                    floor = np.partition(seen, -k, axis=1)[:, -k]
                query, member, score = held[1].search(q, own, k, floor)
                keep = best(query, held[1].ids[member], score, k)
                yield pd.DataFrame({"_row": row.q_block * QUERY_BLOCK + query[keep], "query_id": own[query[keep]], "vec_id": held[1].ids[member[keep]], "score": score[keep]})

    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vals", "wide", "dims", "block")])
    # lengths are few, so that they are no key to deal by
    pairs = index.join(asked, F.abs(F.col("dims") - F.col("q_dims")) < 1)
    found = pairs.mapInPandas(search, "_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
