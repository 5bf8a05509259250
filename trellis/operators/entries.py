"""Entries of a reference book: starts judged from the lines that follow, blocks between starts, sections, health of the cut.

A title is a short line of Han characters. It starts an entry if two header lines in Latin script follow, or else if the
text itself begins on the next line. Only titles look ahead, by joins on line numbers; only starts are ordered; lines meet
their entry by number. So no task holds a book, and an entry is the largest thing gathered.

Defined cases: lines before the first start belong to no entry; a title at the end of a book starts none; a section named
twice keeps its last text; texts without a piece part have empty piece sections; an empty book: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..functions.values import HEADER_NOISE, around, is_body, is_latin_header, is_short_han

# Titles that start no entry, the line behind which the prepared piece is described, a section's mark.
EXCLUDED_TITLES, PIECE_MARK, SECTION = ("饮片",), "\n饮片\n", "【([^】]+)】"
LOWERCASE, NO_HEADER = "third_line_contains_lowercase", "missing_english_header"


def starts(lines: DataFrame, key: str) -> DataFrame:
    """key, start, title, rule, header (the lines behind the title), flags of (key, line_no, line)."""
    titles = lines.where(is_short_han(F.col("line"))).select(key, F.col("line_no").alias("start"), strip_ws(F.col("line")).alias("title"))
    titles = titles.where(~F.col("title").isin(*EXCLUDED_TITLES))
    ahead = lambda k: lines.select(F.col(key).alias("_k"), (F.col("line_no") - k).alias("_at"), strip_ws(F.col("line")).alias(f"line{k}"))
    out = titles
    for k in (1, 2):
        out = out.join(ahead(k), (F.col(key) == F.col("_k")) & (F.col("start") == F.col("_at")), "left").drop("_k", "_at")
    second, third = F.coalesce("line1", F.lit("")), F.coalesce("line2", F.lit(""))
    headed = is_latin_header(second) & is_latin_header(third)
    rule = F.when(headed, "three_line_header").when(is_body(second), "body_text_fallback")
    small = F.regexp_replace(third, HEADER_NOISE, "").rlike(r"\p{Ll}")
    flags = F.when(~headed, F.array(F.lit(NO_HEADER))).when(small, F.array(F.lit(LOWERCASE))).otherwise(F.array())
    header = F.when(headed, F.array(second, third)).otherwise(F.array(second))
    return out.select(key, "start", "title", rule.alias("rule"), header.alias("header"), flags.alias("flags")).where("rule IS NOT NULL")


def blocks(lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, start, end, title, text: from every start to the line before the next one."""
    last = lines.groupBy(F.col(key).alias("_k")).agg(F.max("line_no").alias("_last"))
    nxt = F.lead("start").over(W.partitionBy(key).orderBy("start"))
    ranges = found.select(key, "start", "title", nxt.alias("_n")).join(last, F.col(key) == F.col("_k")).select(key, "start", "title", F.coalesce(F.col("_n") - 1, F.col("_last")).alias("end"))
    members = ranges.select(F.col(key).alias("_k"), "start", "end", "title", F.explode(F.sequence("start", "end")).alias("_at"))
    held = lines.join(members, (F.col(key) == F.col("_k")) & (F.col("line_no") == F.col("_at")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return held.groupBy(key, "start", "end", "title").agg(strip_ws(text).alias("text"))


def sections(text: Column) -> Column:
    """map of section name to text."""
    names = F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), strip_ws)
    bodies = F.split(text, SECTION)
    later = lambda i: F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1)))
    entries = F.transform(names, lambda n, i: F.struct(n.alias("name"), strip_ws(F.get(bodies, i + 1)).alias("text"), F.array_contains(later(i), n).alias("again")))
    return F.map_from_entries(F.transform(F.filter(entries, lambda e: ~e["again"]), lambda e: F.struct(e["name"], e["text"])))


def parsed(entries: DataFrame) -> DataFrame:
    """entries with header_lines, base_description, sections, piece_sections."""
    two = around(F.col("text"), PIECE_MARK)
    filled = F.filter(F.transform(F.split("_before", "\n"), strip_ws), lambda x: x != "")
    told = entries.withColumn("_before", two["before"]).withColumn("_behind", two["behind"]).withColumn("_lines", filled)
    described = F.filter(F.slice("_lines", 4, F.greatest(F.size("_lines"), F.lit(1))), lambda x: ~x.startswith("【"))
    out = told.withColumn("header_lines", F.slice("_lines", 2, 2)).withColumn("base_description", F.get(described, 0))
    return out.withColumn("sections", sections(F.col("_before"))).withColumn("piece_sections", sections(F.col("_behind"))).drop("_before", "_behind", "_lines")


def health(found: DataFrame, key: str) -> DataFrame:
    """found with labels: what is odd about a start, among them titles that occur again with the same or other headers."""
    pair = F.struct(F.array_join("header", "\n").alias("h"), "rule")
    by = found.groupBy(F.col(key).alias("_k"), F.col("title").alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.min(pair).alias("_lo"), F.max(pair).alias("_hi"))
    told = found.join(by, (F.col(key) == F.col("_k")) & (F.col("title") == F.col("_t")))
    again = F.when(F.col("_n") > 1, F.when(F.col("_lo") != F.col("_hi"), "duplicate_title_with_distinct_headers").otherwise("duplicate_title_repeated"))
    labels = F.array(F.when(F.col("rule") == "body_text_fallback", "header_missing_english"), F.when(F.array_contains("flags", LOWERCASE), "header_third_line_mixed_case"), again)
    return told.withColumn("labels", F.array_compact(labels)).drop("_k", "_t", "_n", "_lo", "_hi")


def report(lines: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """(section, what, n): entries, starts by rule, excluded titles, titles that occur again, health labels, suspicious entries."""
    count = F.count(F.lit(1)).alias("n")
    part = lambda rows, section, what: rows.groupBy(what.alias("what")).agg(count).select(F.lit(section).alias("section"), "what", "n")
    excluded = lines.select(strip_ws(F.col("line")).alias("line")).where(F.col("line").isin(*EXCLUDED_TITLES))
    again = checked.groupBy(key, "title").agg(count).where("n > 1")
    odd = checked.where(F.size(F.filter("labels", lambda x: x != "header_third_line_mixed_case")) > 0)
    out = [part(checked, "entries", F.lit("all")), part(checked, "rule", F.col("rule")), part(excluded, "excluded", F.col("line")), part(again, "repeated_titles", F.lit("all"))]
    out += [part(checked.select(F.explode("labels").alias("label")), "health", F.col("label")), part(odd, "suspicious", F.lit("all"))]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
