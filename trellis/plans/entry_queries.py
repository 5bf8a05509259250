"""Entries of books that are made of the documents' lines: each line's number says what becomes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries as E
from ..operators import segment as S
from .registry import query
from .views import table

LETTERS, HAN = "abcdefghijklmnopqrstuvwxyz", "甘草当归黄芪人参茯苓白术川芎地芍桂枝麻杏石膏知母柴胡"
#: What line n of a document becomes: a title, two lines as they are, a first sentence, sections, the mark of the piece.
LINE = f"""CASE (no + doc_id) % 9 WHEN 0 THEN concat('药', translate(left(lower(line), 3), '{LETTERS}', '{HAN}')) WHEN 1 THEN left(line, 30) WHEN 2 THEN CASE WHEN no % 2 = 0 THEN upper(replace(left(line, 20), 'ß', 's')) ELSE left(line, 20) END
  WHEN 3 THEN concat('药', translate(left(lower(line), 1), '{LETTERS}', '{HAN}')) WHEN 4 THEN concat('本品为', left(line, 12)) WHEN 5 THEN concat(' 【性味】 ', left(line, 10), '【归经】', right(line, 5)) WHEN 6 THEN '饮片' WHEN 7 THEN concat('【性味】', left(line, 8)) ELSE concat('【用法】', left(line, 9), '【用法】 x') END"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text").withColumnRenamed("line_no", "no")
    return rows.select("doc_id", (F.col("no") + 1).alias("line_no"), F.expr(LINE).alias("line"))


BASE = rf"""l0 AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS no, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, no + 1 AS line_no, {LINE} AS line FROM l0),
k AS (SELECT *, trim(line, E' \t\r\n') AS s FROM l),
b AS (SELECT *, regexp_replace(s, '[\s\-‐‑–—·．.()（）,，/:：]+', '', 'g') AS bare FROM k),
h AS (SELECT *, NOT regexp_matches(s, '[一-鿿]') AND length(bare) >= 3 AND length(bare) - length(regexp_replace(bare, '\p{{L}}', '', 'g')) >= greatest(3, floor(length(bare) * 0.8)) AS latin, s LIKE '本品为%' OR s LIKE '本品由%' AS body FROM b),
a AS (SELECT *, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2, coalesce(lead(latin) OVER w, false) AND coalesce(lead(latin, 2) OVER w, false) AS headed, coalesce(lead(body) OVER w, false) AS bodied, lead(bare, 2) OVER w AS bare2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
st AS (SELECT doc_id, line_no AS start, s AS title, CASE WHEN headed THEN 'three_line_header' ELSE 'body_text_fallback' END AS rule, CASE WHEN headed THEN s1 || '|' || s2 ELSE s1 END AS header,
  CASE WHEN NOT headed THEN 'missing_english_header' WHEN regexp_matches(bare2, '\p{{Ll}}') THEN 'third_line_contains_lowercase' ELSE '' END AS flags FROM a WHERE regexp_matches(s, '^[一-鿿]{{2,20}}$') AND s <> '饮片' AND (headed OR bodied))"""
BLOCKS = r"""r AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, (SELECT max(line_no) FROM l WHERE l.doc_id = st.doc_id)) AS stop FROM st),
e AS (SELECT r.doc_id, start, stop, title, trim(string_agg(line, chr(10) ORDER BY line_no), E' \t\r\n') AS text FROM r JOIN l ON l.doc_id = r.doc_id AND line_no BETWEEN start AND stop GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN strpos(text, E'\n饮片\n') > 0 THEN left(text, strpos(text, E'\n饮片\n') - 1) ELSE text END AS before, CASE WHEN strpos(text, E'\n饮片\n') > 0 THEN substr(text, strpos(text, E'\n饮片\n') + 4) ELSE '' END AS behind FROM e),
f AS (SELECT *, list_filter(list_transform(string_split(before, chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS ls FROM p)"""


def _sections(column: str) -> str:
    """name=text of all sections, sorted; of a name the last."""
    names, bodies = f"regexp_extract_all({column}, '【([^】]+)】', 1)", f"regexp_split_to_array({column}, '【[^】]+】')"
    return rf"""array_to_string(list_sort(list_filter(list_transform({names}, lambda n, i: CASE WHEN NOT list_contains({names}[i + 1:], n) THEN trim(n) || '=' || trim({bodies}[i + 1], E' \t\r\n') END), lambda x: x IS NOT NULL)), '|')"""


@query(f"WITH {BASE} SELECT * FROM st")
def entry_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.starts(lines(spark, sf_dir), "doc_id")
    return s.select("doc_id", "start", "title", "rule", F.array_join("header", "|").alias("header"), F.array_join("flags", "|").alias("flags"))


@query(f"WITH {BASE}, {BLOCKS} SELECT doc_id, start, stop, title, md5(text) AS digest, array_to_string(ls[2:3], '|') AS header_lines, list_filter(ls[4:], lambda x: NOT starts_with(x, '【'))[1] AS base_description, {_sections('before')} AS sections, {_sections('behind')} AS piece_sections FROM f")
def entry_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with header, first description and sections of the raw and the prepared drug."""
    rows = lines(spark, sf_dir)
    e = E.parsed(E.blocks(rows, E.starts(rows, "doc_id"), "doc_id"))
    said = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|").alias(c)
    return e.select("doc_id", "start", F.col("end").alias("stop"), "title", F.md5("text").alias("digest"), F.array_join("header_lines", "|").alias("header_lines"), "base_description", said("sections"), said("piece_sections"))


@query(f"""WITH {BASE}, c AS (SELECT *, count(*) OVER t AS n, min((header, rule)) OVER t <> max((header, rule)) OVER t AS other FROM st WINDOW t AS (PARTITION BY doc_id, title)),
g AS (SELECT *, CASE WHEN n > 1 AND other THEN 'duplicate_title_with_distinct_headers' WHEN n > 1 THEN 'duplicate_title_repeated' END AS again FROM c)
SELECT 'entries' AS section, 'all' AS what, count(*) AS n FROM g UNION ALL SELECT 'rule', rule, count(*) FROM g GROUP BY rule UNION ALL SELECT 'excluded', s, count(*) FROM k WHERE s = '饮片' GROUP BY s
UNION ALL SELECT 'repeated_titles', 'all', count(*) FROM (SELECT DISTINCT doc_id, title FROM g WHERE n > 1) UNION ALL SELECT 'health', 'header_missing_english', count(*) FROM g WHERE rule = 'body_text_fallback'
UNION ALL SELECT 'health', 'header_third_line_mixed_case', count(*) FROM g WHERE flags = 'third_line_contains_lowercase' UNION ALL SELECT 'health', again, count(*) FROM g WHERE again IS NOT NULL GROUP BY again
UNION ALL SELECT 'suspicious', 'all', count(*) FROM g WHERE again IS NOT NULL OR rule = 'body_text_fallback'""")
def entry_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return E.report(rows, E.health(E.starts(rows, "doc_id"), "doc_id"), "doc_id")
