"""Mentions over the test tables: words and pairs of words of the benchmark as lexicon, documents as corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mentions as M
from ..operators import segment as S
from .registry import query
from .views import table

TYPES, SIZE, SKIP = ["word", "pair"], 600, r"^[A-Z][a-z]+ \|"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.expr(r"filter(split(text, '[ \\n.,]+'), w -> w <> '')").alias("w"))
    single = words.select(F.col("item_id").alias("ordinal"), F.explode("w").alias("name"), F.lit("word").alias("node_type"))
    pairs = words.select(F.col("item_id").alias("ordinal"), F.explode(F.expr("transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))")).alias("name"), F.lit("pair").alias("node_type"))
    return M.lexicon([single, pairs], TYPES)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    return M.buffers(S.lines(docs, "doc_id", "text"), "doc_id", SIZE, SKIP)


BUFFERS = r"""d AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
l0 AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS no, trim(unnest(t), E' \t\r\x0b\x0c') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM d)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM l0 WHERE line <> '' AND NOT regexp_matches(line, '^[A-Z][a-z]+ \|')),
r AS (SELECT doc_id, i, no, no AS start, CASE WHEN length(line) >= 600 THEN 0 ELSE length(line) END AS run FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.no, CASE WHEN r.run = 0 THEN l.no ELSE r.start END, CASE WHEN r.run + length(l.line) >= 600 THEN 0 ELSE r.run + length(l.line) END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
c AS (SELECT r.doc_id, r.start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY r.i) AS text FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY 1, 2)"""
HITS = r"""w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \n.,]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT unnest(w) AS name, 'word' AS node_type FROM w UNION SELECT w[i] || ' ' || w[i + 1], 'pair' FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
n AS (SELECT name, max(node_type) AS node_type FROM x WHERE length(name) BETWEEN 2 AND 20 GROUP BY name),
p AS (SELECT string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) AS p FROM n),
h AS (SELECT DISTINCT doc_id, start, unnest(regexp_extract_all(text, (SELECT p FROM p))) AS name FROM c)"""


@query(f"WITH RECURSIVE {BUFFERS} SELECT doc_id, start, n_lines, length(text) AS n_chars, md5(text) AS digest FROM c")
def corpus_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered by running length, under the number of their first line."""
    return chunks(spark, sf_dir).select("doc_id", "start", "n_lines", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH RECURSIVE {BUFFERS}, {HITS} SELECT name, node_type, doc_id, start, n_chunks FROM (SELECT name, node_type, min((doc_id, start)) AS k, count(*) AS n_chunks FROM h JOIN n USING (name) GROUP BY 1, 2) q, LATERAL (SELECT k[1] AS doc_id, k[2] AS start)")
def corpus_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first buffer of the corpus that mentions each name, and how many do."""
    return M.first_mentions(M.mentions(chunks(spark, sf_dir), ["doc_id", "start"], lexicon(spark, sf_dir)), ["doc_id", "start"])
