"""Queries on texts: keys, redaction, mentions, segments, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segment as S
from .registry import query
from .views import table


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' (' || p_type || ')', '\s+', '', 'g'), '[().,;:!?_~-]', '', 'g') AS surface FROM part""")
def surface_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.surface_key(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("surface"))


@query("""SELECT doc_id, sum(length(text) - length(translate(text, ',;:.~', ''))) AS n_marks, md5(translate(text, ',;:.~', '，；：。～')) AS digest FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text""".replace("sum(length(text) - length(translate(text, ',;:.~', '')))", "(length(text) - length(translate(text, ',;:.~', '')))::INT"))
def cn_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", (F.length("text") - F.length(F.translate("text", X.ASCII_PUNCT, ""))).cast("int").alias("n_marks"), F.md5(X.cn_punct(F.col("text"))).alias("digest")).distinct()


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8})($|[^0-9])')::INT AS has_phone, regexp_matches(text, '(^|[^0-9])[1-9][0-9]{5}(18|19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]($|[^0-9])')::INT AS has_id_card, regexp_matches(text, '住院号[:：]?\s*[0-9]+')::INT AS has_admission,
  regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')::INT AS has_email FROM documents WHERE text IS NOT NULL""")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", *X.pii_flags(F.col("text")))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[mail]', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def redact_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(F.regexp_replace("text", X.EMAIL, "[mail]"), 256).alias("digest"))


def _unbounded(inner: str, pattern: str, mark: str) -> str:
    """A pattern between non-digits without look-around; twice, as matches may share the character between them."""
    once = lambda x: rf"regexp_replace({x}, '(^|[^0-9]){pattern}($|[^0-9])', '\1{mark}\2', 'g')"
    return once(once(inner))


REDACT_SQL = _unbounded("text", "(?:1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8})", "[已过滤电话]")
REDACT_SQL = _unbounded(REDACT_SQL, "[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]", "[已过滤证件]")
REDACT_SQL = rf"regexp_replace(regexp_replace({REDACT_SQL}, '住院号[:：]?\s*[0-9]+', '住院号[已过滤]', 'g'), '国药准字[A-Za-z0-9]+', '[已过滤批准文号]', 'g')"


@query(f"SELECT doc_id, sha256({REDACT_SQL}) AS digest, {REDACT_SQL} <> text AS changed FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole texts replaced by marks."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("digest"), (X.redact(F.col("text")) != F.col("text")).alias("changed"))


LEXICON = ["the", "theand", "that", "thing", "nation", "tion", "une", "und", "les", "der", "que"]


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{X.alternation(LEXICON)}'))), ',') AS hits, len(regexp_extract_all(text, '{X.alternation(LEXICON)}'))::INT AS n_hits FROM documents WHERE text IS NOT NULL""")
def lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost, longest dictionary matches."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    hits = F.regexp_extract_all("text", F.lit(X.alternation(LEXICON)), F.lit(0))
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("hits"), F.size(hits).alias("n_hits"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{X.alternation(LEXICON)}'))), ',') AS hits FROM documents WHERE text IS NOT NULL""")
def trie_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the trie, as for large lexicons."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(F.array_sort(X.trie_hits(LEXICON)(F.col("text"))), ",").alias("hits"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, sum((length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM l)
SELECT doc_id, segment::BIGINT AS segment, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, count(*) AS n_lines FROM s GROUP BY doc_id, segment""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short line opens a segment."""
    rows = S.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return S.segments(rows, "doc_id", F.length("line") < 60).select("doc_id", "segment", "first_line", "last_line", "n_lines")


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1) AS t FROM pages WHERE html IS NOT NULL) SELECT page_id, len(t)::INT AS n_headings, array_to_string(t, '|') AS headings FROM h""")
def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    t = F.regexp_extract_all("html", F.lit(r"<h[1-3][^>]*>([^<]*)</h[1-3]>"), F.lit(1))
    return p.select("page_id", F.size(t).alias("n_headings"), F.array_join(t, "|").alias("headings"))


@query("""WITH w AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS nv FROM conversations)
SELECT conv_id, turn, CASE WHEN nr = 'assistant' THEN nv END::INT AS answer_chars FROM w WHERE role = 'user'""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question takes the length of the answer that follows it."""
    c = table(spark, sf_dir, "conversations").withColumn("value", F.length("text"))
    out = S.adjacent_pairs(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", "conv_id")
    return out.select("conv_id", "turn", F.col("paired").alias("answer_chars"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,11}'))) AS name FROM documents) SELECT name, count(*) AS n_docs, min(doc_id) AS first_doc FROM w GROUP BY name""")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as candidate names, with their first document."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,11}"), F.lit(0)))).alias("name"))
    return w.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""SELECT min(doc_id) + g AS doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d, (SELECT unnest(generate_series(0, (SELECT max(doc_id) - min(doc_id) FROM documents WHERE lang = 'en'))) AS g) s GROUP BY g HAVING min(doc_id) + g NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing_ids(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id")


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents),
n AS (SELECT item_id, count(*) AS total FROM b GROUP BY item_id), m AS (SELECT doc_id, item_id, count(*) AS shared FROM b JOIN d USING (w) GROUP BY ALL)
SELECT doc_id, item_id, shared, total FROM m JOIN n USING (item_id) WHERE 10 * shared >= 9 * total""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold nine tenths or more of a benchmark item's words.

    Such a document misses at most a tenth, so it holds one of the item's rarest tenth plus one words: only
    those bring candidates, which are then counted whole. Frequent words join nothing.
    """
    from pyspark.sql import Window as W

    words = F.array_distinct(F.split(F.lower("text"), " "))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("bw")).where("bw IS NOT NULL")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("dw"))
    item_words, doc_words = b.select("item_id", F.size("bw").alias("total"), F.explode("bw").alias("w")), d.select("doc_id", F.explode("dw").alias("w"))
    often = doc_words.join(item_words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("f", F.lit(0)), "w"))
    rare = item_words.join(often, "w", "left").withColumn("r", rank).where(F.col("r") <= F.col("total") - F.ceil(F.col("total") * 9 / 10) + 1)
    pairs = doc_words.join(rare.select("w", "item_id"), "w").select("doc_id", "item_id").distinct()
    found = pairs.join(b, "item_id").join(d, "doc_id").select("doc_id", "item_id", F.size(F.array_intersect("bw", "dw")).cast("long").alias("shared"), F.size("bw").cast("long").alias("total"))
    return found.where("10 * shared >= 9 * total").distinct()


@query("""SELECT doc_id, substr(sha256(text), 1, 12) AS short_hash, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS preview FROM documents WHERE text IS NOT NULL""")
def clipped_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.short_hash(F.col("text")).alias("short_hash"), X.clip(F.col("text"), 160).alias("preview"))
