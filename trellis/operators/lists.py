"""Ordered, filtered and folded lists: pages with totals, newest first, last calls, edges of drafts, unions of graphs.

Defined cases: a filter that is null does not filter; a page past the end has no rows, and its totals are still given by
``totals``; equal sort keys are told apart by the given unique column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bags import sorted_json
from ..functions.text import strip_ws


def filtered(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal every filter that is given."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def totals(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """total, page (from 1), page_size, has_more."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.lit(offset // limit + 1).alias("page"), F.lit(limit).alias("page_size"), (F.lit(offset + limit) < n).alias("has_more"))


def newest(rows: DataFrame, by: str, unique: str, limit: int) -> DataFrame:
    return page(rows, [F.desc(by), F.desc(unique)], limit)


def unread_by_user(rows: DataFrame, user: str, read: Column) -> DataFrame:
    """user, total, unread: of all rows, whatever a page shows."""
    return rows.groupBy(user).agg(F.count(F.lit(1)).alias("total"), F.count_if(~read).alias("unread"))


def in_range(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text holds ``part`` or is null."""
    return rows.where(F.col(column).isNull() | F.col(column).contains(part))


def last_calls(calls: DataFrame, returns: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last n calls of each key that have returned: each with its result, by call_id."""
    done = calls.join(returns, ["call_id"])
    return done.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("nth") <= n)


def most_complete(rows: DataFrame, key: str, columns: list[str], ordinal: str) -> DataFrame:
    """Of each key the row with most filled columns, the first of equals."""
    filled = sum(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns)
    best = F.max_by(F.struct(*rows.columns), F.struct(filled, -F.col(ordinal)))
    return rows.groupBy(key).agg(best.alias("b")).select("b.*")


def by_rank(rows: DataFrame, kind: str, ranks: list[str], then: list[str]) -> DataFrame:
    """rank of the kind in a list of kinds (behind all for unknown ones) and place in the order of rank, then columns."""
    at = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(kind))
    rank = F.when(at > 0, at - 1).otherwise(len(ranks))
    return rows.withColumn("rank", rank).orderBy("rank", *then)


def fold_edges(edges: DataFrame, key: list[str], keep_first: bool = False, through: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """(edges, conflicts) of rows with key, props (a map), evidence_ref, ordinal.

    Rows of one key must have equal properties; else the key is a conflict and no edge. Evidence is the union of
    all refs, sorted and joined; with ``keep_first`` the first row's ref, the others being the node's alone. ``through`` sees the folded keys before they
    part, to write them once.
    """
    refs = F.min_by("evidence_ref", "ordinal") if keep_first else F.array_join(F.array_sort(F.collect_set("evidence_ref")), " || ")
    rows = edges.withColumn("props_json", sorted_json(F.col("props")))
    folded = rows.groupBy(*key).agg(F.min("props_json").alias("props_json"), F.max("props_json").alias("_most"), refs.alias("evidence"), F.count(F.lit(1)).alias("n"))
    folded = through(folded)
    same = F.col("props_json") == F.col("_most")
    return folded.where(same).drop("_most"), folded.where(~same).select(*key, "n")


def same_ids(left: DataFrame, *right: DataFrame, column: str) -> DataFrame:
    """only_left, only_right: how many ids one side alone has; both 0 if a table is exactly the union of others."""
    other = right[0].select(column)
    for r in right[1:]:
        other = other.union(r.select(column))
    a, b = left.select(column).distinct().withColumn("_l", F.lit(1)), other.distinct().withColumn("_r", F.lit(1))
    both = a.join(b, column, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of tables in which a later table's row of a key replaces an earlier one's."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(n))
        out = p if out is None else out.unionByName(p)
    columns = [c for c in parts[0].columns]
    return out.groupBy(key).agg(F.max_by(F.struct(*columns), "_part").alias("b")).select("b.*")


def store_counts(records: DataFrame, source_edge: str, source_type: str, skip_reason: str) -> DataFrame:
    """What goes to the graph: source_edges, fragment_records, omitted_records, kept_records, kept_edges, in one pass.

    records: node_type, evidence_text, props, edges(array of struct with type). Records to skip and source nodes
    are omitted; edges to sources are not counted as kept."""
    omitted = (F.coalesce(F.col("props")["skip_reason"], F.lit("")) == skip_reason) | (F.col("node_type") == source_type)
    sources = F.size(F.filter("edges", lambda e: e["type"] == source_edge))
    return records.agg(
        F.coalesce(F.sum(sources), F.lit(0)).alias("source_edges"),
        F.count_if(F.coalesce(F.col("evidence_text"), F.lit("")) != "").alias("fragment_records"),
        F.count_if(omitted).alias("omitted_records"),
        F.count_if(~omitted).alias("kept_records"),
        F.coalesce(F.sum(F.when(~omitted, F.size("edges") - sources)), F.lit(0)).alias("kept_edges"),
    )


def numbered_terms(lines: DataFrame, key: str) -> DataFrame:
    """key, code, names, definition of (key, line_no, line) rows.

    A line that is a code opens a term; names follow until, behind one name at least, a line opens the definition;
    all lines from there to the next code are the definition."""
    code, opens = strip_ws(F.col("line")).rlike(r"^[0-9]+(?:\.[0-9]+)+$"), strip_ws(F.col("line")).rlike("^(因|泛指|与|指|临床|注)")
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.where(strip_ws(F.col("line")) != "").withColumn("term", F.sum(code.cast("int")).over(w)).where("term > 0")
    own = W.partitionBy(key, "term").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(key, "term").orderBy("line_no")))
    rows = rows.withColumn("defined", F.max(F.when(opens & (F.col("nth") > 2), 1).otherwise(0)).over(own))
    text = F.struct("line_no", strip_ws(F.col("line")).alias("line"))
    out = rows.groupBy(key, "term").agg(
        F.min_by(strip_ws(F.col("line")), "line_no").alias("code"),
        F.array_sort(F.collect_list(F.when((F.col("nth") > 1) & (F.col("defined") == 0), text))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("defined") == 1, text))).alias("d"),
    )
    return out.where(F.size("n") > 0).select(key, "code", F.col("n.line").alias("names"), F.array_join("d.line", "").alias("definition"))
