"""Documents as labelled cases in three splits; their languages are the vocabulary, with one label that no case has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labelled_cases as C
from .registry import query
from .views import table

CASES = """SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split, doc_id AS line_no, concat(source, '-', CAST(doc_id % 40 AS STRING)) AS user_id,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(n_chars % 20 AS STRING) END AS lcd_id, CASE WHEN n_chars % 13 = 0 THEN lang ELSE concat('d', CAST(n_chars % 23 AS STRING)) END AS lcd_name, CASE WHEN doc_id % 4 = 0 THEN concat(lang, CAST(doc_id % 3 AS STRING)) ELSE lang END AS syndrome,
  concat('住院号', CAST(doc_id % 2 AS STRING)) AS chief_complaint, text AS description, CASE WHEN doc_id % 5 = 0 THEN '中山医院' ELSE '' END AS detection, lang AS norm_syndrome FROM {documents} WHERE lang IS NOT NULL AND n_chars IS NOT NULL AND source IS NOT NULL"""
SQL_CASES = CASES.replace("AS STRING", "AS VARCHAR").format(documents="documents")


def cleaned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d = table(spark, sf_dir, "documents")
    spare = spark.createDataFrame([(0, "unused"), (1, " ")], "line_no long, line string")
    vocabulary = d.where("lang IS NOT NULL").groupBy(F.col("lang").alias("line")).agg(F.min("doc_id").alias("line_no")).select("line_no", "line").unionByName(spare)
    return C.clean(vocabulary, spark.sql(CASES, documents=d))


BASE = f"c AS ({SQL_CASES}), v AS (SELECT 'vocabulary:' || min(doc_id) AS ref, lang AS name FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'vocabulary:0', 'unused'), k AS (SELECT *, lcd_name || '-' || lcd_id || '-' || split || '-' || line_no AS name FROM c)"
TEXT = "chief_complaint || chr(10) || coalesce(description, '') || chr(10) || detection"


@query(f"""WITH {BASE} SELECT '病证' AS node_type, name AS node_name, '来源标注证候' AS tcm_type, ref AS evidence_ref FROM v UNION ALL SELECT DISTINCT '病证', lcd_name, '来源病名', 'lcd_name' FROM c WHERE lcd_id <> '' AND lcd_name NOT IN (SELECT name FROM v)
UNION ALL SELECT '医案', name, '来源病历', split || ':' || line_no FROM k""")
def labelled_case_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)["nodes"]


@query(f"WITH {BASE} SELECT name AS node_name, '关联证候' AS type, norm_syndrome AS target FROM k UNION ALL SELECT name, '关联证候', lcd_name FROM k WHERE lcd_name <> norm_syndrome")
def labelled_case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)["edges"]


def _several(key: str, of: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM c WHERE {key} <> '' AND {of} <> '' GROUP BY 1 HAVING count(DISTINCT {of}) > 1))"


@query(f"""WITH {BASE}, p AS (SELECT lcd_name, norm_syndrome, count(*) AS n FROM c WHERE lcd_id <> '' GROUP BY 1, 2), t AS (SELECT *, {TEXT} AS t FROM c), w AS (SELECT count(*) AS n FROM c GROUP BY user_id, lcd_id, lcd_name, syndrome, chief_complaint, description, detection, norm_syndrome)
SELECT 'rows' AS section, split AS what, count(*) AS n FROM c GROUP BY split UNION ALL SELECT 'names', 'vocabulary', count(*) FROM v UNION ALL SELECT 'names', 'vocabulary_without_case', count(*) FROM v WHERE name NOT IN (SELECT norm_syndrome FROM c)
UNION ALL SELECT 'names', 'lcd_names', count(DISTINCT lcd_name) FROM c WHERE lcd_id <> '' UNION ALL SELECT 'names', 'lcd_ids', count(DISTINCT lcd_id) FROM c WHERE lcd_id <> '' UNION ALL SELECT 'names', 'of_both_kinds', count(DISTINCT lcd_name) FROM c WHERE lcd_id <> '' AND lcd_name IN (SELECT name FROM v)
UNION ALL SELECT 'pairs', 'all', count(*) FROM p UNION ALL SELECT 'pairs', 'with_single_case', count(*) FROM p WHERE n = 1 UNION ALL SELECT 'ambiguous', 'lcd_id', {_several("lcd_id", "lcd_name")} UNION ALL SELECT 'ambiguous', 'lcd_name', {_several("lcd_name", "lcd_id")}
UNION ALL SELECT 'ambiguous', 'syndrome', {_several("syndrome", "norm_syndrome")} UNION ALL SELECT 'syndrome_ne_norm', split, count(*) FROM c WHERE syndrome <> norm_syndrome GROUP BY split
UNION ALL SELECT 'empty', split || ':lcd_id', count(*) FROM c WHERE lcd_id = '' GROUP BY split UNION ALL SELECT 'empty', split || ':detection', count(*) FROM c WHERE detection = '' GROUP BY split UNION ALL SELECT 'empty', split || ':description', count(*) FROM c WHERE coalesce(description, '') = '' GROUP BY split
UNION ALL SELECT 'duplicates', 'groups', count(*) FROM w WHERE n > 1 UNION ALL SELECT 'duplicates', 'extra_copies', coalesce(sum(n - 1), 0)::BIGINT FROM w UNION ALL SELECT 'cross_split', 'user_id', {_several("user_id", "split")}
UNION ALL SELECT 'cross_split', 'fulltext', (SELECT count(*) FROM (SELECT t FROM t GROUP BY t HAVING count(DISTINCT split) > 1)) UNION ALL SELECT 'personal', 'hospital', count(*) FROM c WHERE detection <> '' UNION ALL SELECT 'personal', 'admission', count(*) FROM c
UNION ALL SELECT 'personal', 'phone', count(*) FROM t WHERE regexp_matches(t, '(^|[^0-9])(1[3-9][0-9]{{9}}|0[0-9]{{2,3}}-?[0-9]{{7,8}})($|[^0-9])') HAVING count(*) > 0
UNION ALL SELECT 'personal', 'id_card', count(*) FROM t WHERE regexp_matches(t, '(^|[^0-9])[1-9][0-9]{{5}}(18|19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx]($|[^0-9])') HAVING count(*) > 0""")
def labelled_case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(spark, sf_dir)
    return C.report(c["names"], c["rows"])
