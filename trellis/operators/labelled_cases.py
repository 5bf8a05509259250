"""A source cleaner as one composition: cases with a disease and a syndrome label, in splits, against a vocabulary of labels.

Every label must be in the vocabulary, and what the vocabulary holds without a case is counted. Names become nodes, cases
nodes without their clinical text; the report says how the splits leak into each other (the same user, the same text),
which names are told ambiguously, what is repeated, empty or personal.

Every count is over distinct pairs of what is counted, found as rows, so that a name or text of very many rows is never
one list. Texts are compared by SHA-256.

Defined cases: a vocabulary without a name, with a name twice (as cleaned), labels that are empty or outside of it, and
labels on unlabelled rows are errors; cases without a disease name have one edge; empty tables: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_name, pii_flags
from ..functions.values import clinical_text
from ..functions.vocabulary import WHOLE_NAMES
from ..sources.readers import BadInput

# The columns of a labelled row, those that no label tells, node types, the edge of a case.
COLUMNS = ["user_id", "lcd_id", "lcd_name", "syndrome", "chief_complaint", "description", "detection", "norm_syndrome"]
LABELS = ("syndrome", "norm_syndrome")
DISEASE, CASE, RELATED = "病证", "医案", "关联证候"
HOSPITAL = "[一-鿿]{1,12}(?:医院|卫生院|中医院|人民医院|附属医院)"


def case_rows(spark: SparkSession, path: str, split: str, columns: list[str] = COLUMNS) -> DataFrame:
    """split, line_no and the columns of a file of JSON lines; a line without one of them is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.trim("line") != "")
    rows = whole.select((F.col("n") + 1).cast("long").alias("line_no"), F.from_json("line", "map<string,string>").alias("m"))
    lacking = F.filter(F.array(*[F.lit(c) for c in columns]), lambda c: ~F.coalesce(F.map_contains_key("m", c), F.lit(False)))
    if bad := rows.select("line_no", lacking.alias("l")).where(F.size("l") > 0).limit(5).collect():
        raise BadInput(f"{split}: lines lack keys: {[(r.line_no, r.l) for r in bad]}")
    return rows.select(F.lit(split).alias("split"), "line_no", *[F.col("m")[c].alias(c) for c in columns])


def _name(c: str):  # noqa: ANN202
    return canonical_name(F.coalesce(c, F.lit("")), F.lit(DISEASE), WHOLE_NAMES)


def clean(vocabulary: DataFrame, cases: DataFrame, unlabelled: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes (node_type, node_name, tcm_type, evidence_ref), edges (node_name, type, target), and the cleaned ``names`` and
    ``rows`` for the report. vocabulary: line_no, line; cases: split, line_no and COLUMNS; unlabelled: the same."""
    names = vocabulary.select("line_no", _name("line").alias("name")).where("name <> ''")
    if twice := names.groupBy("name").count().where("count > 1").limit(5).collect():
        raise BadInput(f"duplicate vocabulary names: {[r.name for r in twice]}")
    if names.isEmpty():
        raise BadInput("the vocabulary is empty")
    cleaned = {c: _name(c) for c in ("lcd_name", *LABELS)}
    rows = cases.select("split", "line_no", *[F.col(c).alias(f"raw_{c}") for c in COLUMNS], *[v.alias(c) for c, v in cleaned.items()], F.trim(F.coalesce("lcd_id", F.lit(""))).alias("lcd_id"))
    at = F.concat_ws(":", "split", "line_no")
    if bad := rows.where("norm_syndrome = ''").select(at.alias("at")).limit(5).collect():
        raise BadInput(f"empty norm_syndrome: {[r.at for r in bad]}")
    unknown = rows.join(names.select(F.col("name").alias("_n")), F.col("norm_syndrome") == F.col("_n"), "left_anti")
    if bad := unknown.select(at.alias("at"), "norm_syndrome").limit(5).collect():
        raise BadInput(f"norm_syndrome not in vocabulary: {[tuple(r) for r in bad]}")
    if unlabelled is not None:
        told = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in LABELS if c in unlabelled.columns], F.lit(False))
        if bad := unlabelled.where(told).select(at.alias("at")).limit(5).collect():
            raise BadInput(f"unexpected labels: {[r.at for r in bad]}")
    syndromes = names.select(F.lit(DISEASE).alias("node_type"), F.col("name").alias("node_name"), F.lit("来源标注证候").alias("tcm_type"), F.concat(F.lit("vocabulary:"), F.col("line_no").cast("string")).alias("evidence_ref"))
    told = rows.where("lcd_id <> '' AND lcd_name <> ''").select("lcd_name").distinct().join(names.select(F.col("name").alias("lcd_name")), "lcd_name", "left_anti")
    diseases = told.select(F.lit(DISEASE).alias("node_type"), F.col("lcd_name").alias("node_name"), F.lit("来源病名").alias("tcm_type"), F.lit("lcd_name").alias("evidence_ref"))
    case_name = F.concat_ws("-", "lcd_name", F.coalesce("raw_lcd_id", F.lit("")), "split", "line_no")
    own = rows.select(F.lit(CASE).alias("node_type"), case_name.alias("node_name"), F.lit("来源病历").alias("tcm_type"), at.alias("evidence_ref"))
    targets = F.array_distinct(F.filter(F.array("norm_syndrome", "lcd_name"), lambda x: x != ""))
    edges = rows.select(case_name.alias("node_name"), F.lit(RELATED).alias("type"), F.explode(targets).alias("target"))
    return {"nodes": syndromes.unionByName(diseases).unionByName(own), "edges": edges, "names": names, "rows": rows}


def report(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, what, n)."""
    one = F.count(F.lit(1)).alias("n")
    by = lambda df, section, what: df.groupBy(what.alias("what")).agg(one).select(F.lit(section).alias("section"), "what", "n")
    total = lambda df, section, what: df.agg(one).select(F.lit(section).alias("section"), F.lit(what).alias("what"), "n")
    several = lambda key, of: rows.where((F.col(key) != "") & (F.col(of) != "")).select(key, of).distinct().groupBy(key).agg(one).where("n > 1")
    pairs = rows.where("lcd_id <> '' AND lcd_name <> ''").groupBy("lcd_name", "norm_syndrome").agg(one)
    labelled = rows.where("lcd_id <> '' AND lcd_name <> ''")
    text = clinical_text(*[F.col(f"raw_{c}") for c in ("chief_complaint", "description", "detection")])
    rows = rows.withColumn("user", F.coalesce("raw_user_id", F.lit(""))).withColumn("text", F.sha2(text, 256)).withColumn("whole", F.sha2(F.to_json(F.struct(*[F.col(f"raw_{c}").alias(c) for c in COLUMNS])), 256))
    used = rows.select(F.col("norm_syndrome").alias("name")).distinct()
    copies = rows.groupBy("whole").agg(one).where("n > 1")
    empty = rows.select("split", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(f"raw_{c}", F.lit("")) == "", F.lit(c)) for c in COLUMNS]))).alias("c"))
    flags = pii_flags(text)
    personal = rows.select(*flags, text.rlike(HOSPITAL).cast("int").alias("has_hospital"))
    kinds = F.array(*[F.when(F.col(f"has_{k}") == 1, F.lit(k)) for k in ("phone", "id_card", "admission", "hospital")])
    crossing = lambda key: rows.where(F.col(key) != "").select(key, "split").distinct().groupBy(key).agg(one).where("n > 1")
    parts = [
        by(rows, "rows", F.col("split")), total(names, "names", "vocabulary"), total(names.join(used, "name", "left_anti"), "names", "vocabulary_without_case"), total(labelled.select("lcd_name").distinct(), "names", "lcd_names"),
        total(labelled.select("lcd_id").distinct(), "names", "lcd_ids"), total(labelled.select(F.col("lcd_name").alias("name")).distinct().join(names, "name", "left_semi"), "names", "of_both_kinds"),
        total(pairs, "pairs", "all"), total(pairs.where("n = 1"), "pairs", "with_single_case"), total(several("lcd_id", "lcd_name"), "ambiguous", "lcd_id"), total(several("lcd_name", "lcd_id"), "ambiguous", "lcd_name"),
        total(several("syndrome", "norm_syndrome"), "ambiguous", "syndrome"), by(rows.where("syndrome <> norm_syndrome"), "syndrome_ne_norm", F.col("split")), by(empty, "empty", F.concat_ws(":", "split", "c")),
        total(copies, "duplicates", "groups"), copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicates").alias("section"), F.lit("extra_copies").alias("what"), "n"),
        total(crossing("user"), "cross_split", "user_id"), total(crossing("text"), "cross_split", "fulltext"), by(personal.select(F.explode(F.array_compact(kinds)).alias("k")), "personal", F.col("k")),
    ]
    return reduce(DataFrame.unionByName, parts)
