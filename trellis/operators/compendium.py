"""A source cleaner as one composition: Parquet tables whose columns hold JSON text - herbs, formulas, conditions, relations.

JSON columns are read as variants, so lists of any make-up are taken apart by the engine and what is no string, no list or
cut short is found item by item. Herbs and formulas with one surface are merged where no field contradicts, else each row
stays alone; conditions are taken by tag and identifier, and all holders of one identifier are set aside. A name means a
node within its kind of table only. Nothing is set aside without a row that says why.

Tables carry ``row_no`` (from 1, as in the source). Evidence stays in rows (``evidence``), so that what many rows support
is never one list in one task.

Defined cases: names that agree within a table but for width and case are an error, as are JSON text that is none or of
another kind, list items that are no strings where strings are promised, unknown shapes of relations, and edges of one
key with several doses; absent fields are empty; empty tables: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, has_han, nfc_strip, surface_key
from ..functions.values import one_snomed, trailing_tag
from ..shared import cut
from ..sources.readers import BadInput

# JSON columns: what they hold, the property they become, whether as distinct strings or as compact JSON.
FIELDS = {
    "herbs": [
        ("synonyms", "ARRAY", "aliases", "strings"), ("category", "ARRAY", "category", "strings"), ("properties", "OBJECT", "nature", "json"),
        ("actions", "ARRAY", "source_actions", "json"), ("contraindications", "ARRAY", "contraindication", "strings"), ("interactions", "ARRAY", "source_interactions", "json"),
        ("incompatibility", "ARRAY", "source_incompatibility", "json"), ("notes", "ARRAY", "source_notes", "json"), ("dosage", "ARRAY", "dosage", "json"), ("indications", "ARRAY", "indications", "strings"),
    ],
    "formulas": [
        ("synonyms", "ARRAY", "aliases", "strings"), ("actions", "ARRAY", "source_actions", "json"), ("syndromes", "ARRAY", "syndrome_text", "json"), ("treats", "ARRAY", "indications", "strings"),
        ("contraindications", "ARRAY", "contraindication", "strings"), ("notes", "ARRAY", "source_notes", "json"), ("composition", "OBJECT", "composition_text", "json"),
    ],
    "conditions": [
        ("synonyms", "ARRAY", "aliases", "strings"), ("symptoms", "ARRAY", "core_symptoms", "json"), ("herb_formulas", "ARRAY", "representative_formulas", "json"), ("points", "ARRAY", "related_acupoints", "json"),
    ],
}
# Node type and kind of a table's rows; shapes of relations and the edge each becomes (none: set aside).
NODE_TYPES = {"herbs": "药材", "formulas": "方剂", "conditions": "病证"}
KINDS = {"herbs": "herb", "formulas": "formula", "conditions": "condition"}
SHAPES = {("formula", "herb", "contains"): "组成药材", ("condition", "herb", "treats"): "关联药材", ("condition", "formula", "treats"): None}
SYMPTOM, RELATED_SYMPTOM, ACCEPTED_TAG, MANIFESTATIONS = "症状", "关联症状", "disorder", "clinical_manifestations"
COLUMNS = {"herbs": ["name"], "formulas": ["name"], "conditions": ["name", "description"], "relations": ["source", "target", "source_type", "target_type", "edge_type", "dosage"]}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, ... of a variant; null for none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def read(rows: DataFrame, table: str) -> DataFrame:
    """row_no, name, ident and, for each JSON column, its variant ``v_`` and its compact text ``t_`` (null where empty)."""
    if missing := [c for c in [*COLUMNS[table], *[f[0] for f in FIELDS[table]]] if c not in rows.columns]:
        raise BadInput(f"{table} lacks {missing}")
    out = rows.select("row_no", F.col("name").alias("raw_name"), nfc_strip(F.coalesce("name", F.lit(""))).alias("name"), *COLUMNS[table][1:], *[F.try_parse_json(f[0]).alias(f"v_{f[0]}") for f in FIELDS[table]])
    text = lambda f: F.nullif(F.nullif(F.to_json(F.col(f"v_{f}")), F.lit("[]")), F.lit("{}")).alias(f"t_{f}")
    return out.select("*", fold_key(F.col("name")).alias("ident"), *[text(f[0]) for f in FIELDS[table]])


def strings(read_rows: DataFrame, table: str) -> DataFrame:
    """(row_no, field, pos, item, kind) of all lists that promise strings."""
    lists = [read_rows.select("row_no", F.lit(f).alias("field"), F.posexplode(_array(F.col(f"v_{f}"))).alias("pos", "v")) for f, _, _, how in FIELDS[table] if how == "strings"]
    items = _union(lists)
    return items.select("row_no", "field", "pos", nfc_strip(F.try_variant_get("v", "$", "string")).alias("item"), _kind(F.col("v")).alias("kind"))


def faults(tables: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
    """(table, row_no, fault): every row that breaks a promise."""
    out = []
    for table, rows in tables.items():
        wrong = [F.when(~F.coalesce(_kind(F.col(f"v_{f}")) == kind, F.lit(False)), F.lit(f"{f} must be JSON text of an {kind}")) for f, kind, _, _ in FIELDS[table]]
        own = rows.select(F.lit(table).alias("table"), "row_no", F.explode(F.array_compact(F.array(F.when(F.col("name") == "", "empty name"), *wrong))).alias("fault"))
        twice = rows.groupBy("ident").agg(F.count(F.lit(1)).alias("c"), F.min("row_no").alias("row_no"), F.max("row_no").alias("other")).where("c > 1")
        out += [own, twice.select(F.lit(table).alias("table"), "row_no", F.concat(F.lit("ambiguous identity key "), "ident", F.lit(", also row "), F.col("other").cast("string")).alias("fault"))]
        out.append(strings(rows, table).where("kind <> 'STRING'").select(F.lit(table).alias("table"), "row_no", F.concat("field", F.lit(" holds what is no string")).alias("fault")))
    shape = F.concat_ws("->", "source_type", "target_type", "edge_type")
    out.append(relations.where(~shape.isin(*["->".join(x) for x in SHAPES])).select(F.lit("relations").alias("table"), "row_no", F.concat(F.lit("unsupported relation shape "), shape).alias("fault")))
    return _union(out)


def units(rows: DataFrame, table: str) -> DataFrame:
    """One row a source row: row_no, ident, node_name, group size, merged, conflict, and for each field the row and the text
    that the node takes it from.

    A surface's rows are folded to the first filled text of each field and the least and greatest ones, which differ where
    the rows contradict each other."""
    fields = [f[0] for f in FIELDS[table]]
    keyed = rows.withColumn("surface", fold_key(surface_key(F.col("name"))))
    filled = sum(F.col(f"t_{f}").isNotNull().cast("int") for f in fields)
    spaces = F.length("raw_name") - F.length(F.replace("raw_name", F.lit(" ")))
    folds = [x for f in fields for x in (F.min(f"t_{f}").alias(f"lo_{f}"), F.max(f"t_{f}").alias(f"hi_{f}"), F.min_by(F.struct("row_no", f"t_{f}"), F.when(F.col(f"t_{f}").isNotNull(), F.col("row_no"))).alias(f"first_{f}"))]
    groups = keyed.groupBy(F.col("surface").alias("_s")).agg(F.count(F.lit(1)).alias("size"), F.max_by("name", F.struct(filled, spaces, -F.col("row_no"))).alias("best"), *folds)
    contradicts = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"lo_{f}") != F.col(f"hi_{f}"), F.lit(False)) for f in fields])
    named = F.filter(F.array(*[F.when(F.col(f"lo_{f}") != F.col(f"hi_{f}"), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull())
    groups = groups.select("_s", "size", "best", contradicts.alias("conflict"), named.alias("conflicting"), *[f"first_{f}" for f in fields])
    joined = keyed.join(groups, F.col("surface") == F.col("_s"))
    taken = [F.when(F.col("conflict"), F.struct("row_no", f"t_{f}")).otherwise(F.col(f"first_{f}")).alias(f) for f in fields]
    alone = F.col("conflict") & (F.col("size") > 1)
    return joined.select("row_no", "ident", "name", "surface", F.when(alone, F.col("raw_name")).otherwise(F.col("best")).alias("node_name"), "size", "conflict", "conflicting", *taken)


def conditions(rows: DataFrame) -> DataFrame:
    """row_no, name, ident, tag, snomed_id, reason (null: taken). An identifier's holders are all set aside, whatever their tag."""
    listed = strings(rows, "conditions").where("item <> ''").groupBy("row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))  # a row's own list
    told = rows.join(listed.withColumnRenamed("row_no", "_r"), F.col("row_no") == F.col("_r"), "left").select("row_no", "name", "ident", trailing_tag(F.col("name")).alias("tag"), one_snomed(F.coalesce("items", F.array().cast("array<string>"))).alias("s"))
    shared = told.where(F.col("s.id").isNotNull()).groupBy(F.col("s.id").alias("_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    told = told.join(shared, F.col("s.id") == F.col("_id"), "left")
    reason = F.when(F.col("_id").isNotNull(), F.concat(F.lit("duplicate_snomed_id:"), "_id")).otherwise(F.coalesce("s.reason", F.when(F.col("tag") != ACCEPTED_TAG, F.concat(F.lit("unsupported_condition_tag:"), "tag"))))
    return told.select("row_no", "name", "ident", "tag", F.col("s.id").alias("snomed_id"), reason.alias("reason"))


def manifestations(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(row_no, ref, name, reason) of every item of every pattern of the conditions that are taken; reason: why it is no symptom."""
    own = rows.join(taken.select(F.col("row_no").alias("_r")), F.col("row_no") == F.col("_r"), "left_semi")
    patterns = own.select("row_no", F.posexplode(_array(F.col("v_symptoms"))).alias("p", "v"))
    at = F.concat(F.lit("conditions:row:"), F.col("row_no").cast("string"), F.lit(":symptoms:"), (F.col("p") + 1).cast("string"))
    inner = F.try_variant_get("v", f"$.{MANIFESTATIONS}", "variant")
    kind = _kind(inner)
    broken = F.when(_kind(F.col("v")) != "OBJECT", "invalid_pattern_objects").when(kind.isNull() | (kind == "VOID"), "missing_manifestation_lists").when(kind != "ARRAY", "invalid_manifestation_lists")
    patterns = patterns.select("row_no", "p", at.alias("ref"), broken.alias("broken"), _array(F.col("v"), f"$.{MANIFESTATIONS}").alias("items"))
    bad = patterns.where("broken IS NOT NULL").select("row_no", "p", F.lit(0).alias("i"), "ref", F.lit(None).cast("string").alias("name"), F.col("broken").alias("reason"))
    items = patterns.where("broken IS NULL").select("row_no", "p", "ref", F.posexplode("items").alias("i", "v"))
    name = nfc_strip(F.try_variant_get("v", "$", "string"))
    items = items.select("row_no", "p", "i", F.concat("ref", F.lit(f":{MANIFESTATIONS}:"), (F.col("i") + 1).cast("string")).alias("ref"), name.alias("name"), _kind(F.col("v")).alias("kind"))
    reason = F.when(F.col("kind") != "STRING", "non_string_manifestations").when(F.col("name") == "", "empty_manifestations").when(F.col("name").endswith("...") | F.col("name").endswith("…"), "truncated_manifestations")
    return bad.unionByName(items.select("row_no", "p", "i", "ref", "name", reason.alias("reason")))


def _text_props(table: str, taken: list[tuple[str, Column]]) -> Column:
    bag = F.create_map(*[x for k, v in taken for x in (F.lit(k), v)])
    return F.map_filter(bag, lambda k, v: v.isNotNull() & (v != ""))


def clean(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """nodes (node_type, node_name, aliases, lists, props), evidence (node_type, node_name, ref), edges (node_type, node_name,
    type, target, dosage, ref: the first, n), set_aside (what, ref, reason), and what the report counts."""
    relations = cut(tables["relations"].select("row_no", *COLUMNS["relations"]), "relations")
    rows = {t: cut(read(tables[t], t), t) for t in FIELDS}  # JSON is parsed and names are folded once
    if bad := faults(rows, relations).orderBy("table", "row_no", "fault").limit(5).collect():
        raise BadInput("; ".join(f"{r.table}:{r.row_no}: {r.fault}" for r in bad))
    node = ["node_type", "node_name"]
    ref = lambda table: F.concat(F.lit(f"{table}:row:"), F.col("row_no").cast("string"))
    grouped = {t: cut(units(rows[t], t), "units") for t in ("herbs", "formulas")}
    judged = cut(conditions(rows["conditions"]), "conditions")
    taken = judged.where("reason IS NULL")

    known, evidence, uses, bags, names = [], [], [], [], []
    for table, rows_of in grouped.items():
        own = rows_of.withColumn("node_type", F.lit(NODE_TYPES[table])).withColumn("kind", F.lit(KINDS[table]))
        known.append(own.select("kind", "ident", *node))
        evidence.append(own.select(*node, ref(table).alias("ref")))
        names.append(own.where("name <> node_name").select(*node, F.lit("aliases").alias("list"), F.struct(F.lit(1).alias("part"), F.col("row_no").cast("long").alias("at")).alias("_o"), F.col("name").alias("item")))
        fields = [(f, p) for f, _, p, how in FIELDS[table] if how == "strings"]
        picked = own.select(*node, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("list"), F.col(f"{f}.row_no").alias("row")) for f, p in fields])).alias("u")).select(*node, "u.*").where("row IS NOT NULL").distinct()
        uses.append(picked.withColumn("table", F.lit(table)))
        texts = [(p, F.col(f"{f}.t_{f}")) for f, _, p, how in FIELDS[table] if how == "json"]
        bags.append(own.select(*node, _text_props(table, texts).alias("props")).groupBy(*node).agg(F.first("props").alias("props")))  # equal for all rows of a node
    mine = rows["conditions"].join(taken.select(F.col("row_no").alias("_r"), "snomed_id"), F.col("row_no") == F.col("_r")).withColumn("node_type", F.lit(NODE_TYPES["conditions"])).withColumn("node_name", F.col("name"))
    known.append(mine.select(F.lit(KINDS["conditions"]).alias("kind"), "ident", *node))
    uses.append(mine.select(*node, F.lit("synonyms").alias("field"), F.lit("aliases").alias("list"), F.col("row_no").alias("row"), F.lit("conditions").alias("table")))
    texts = [(p, F.col(f"t_{f}")) for f, _, p, how in FIELDS["conditions"] if how == "json"]
    bags.append(mine.select(*node, _text_props("conditions", [*texts, ("snomed_id", F.col("snomed_id")), ("description", nfc_strip(F.coalesce("description", F.lit("")))), ("tcm_type", F.lit("SNOMED disorder"))]).alias("props")))

    found = manifestations(rows["conditions"], taken)
    shown = found.where("reason IS NULL").withColumn("ident", fold_key(F.col("name"))).withColumn("_at", F.struct("row_no", "p", "i"))
    symptoms = shown.groupBy("ident").agg(F.min_by("name", "_at").alias("target"))
    shown = shown.join(symptoms, "ident").join(mine.select(F.col("row_no").alias("_r"), *node), F.col("row_no") == F.col("_r"))
    evidence += [mine.select(*node, ref("conditions").alias("ref")), shown.select(*node, "ref"), shown.select(F.lit(SYMPTOM).alias("node_type"), F.col("target").alias("node_name"), "ref")]
    bags.append(symptoms.select(F.lit(SYMPTOM).alias("node_type"), F.col("target").alias("node_name"), _text_props("", [("category", F.lit("临床表现（含体征）")), ("tcm_type", F.lit("来源标注临床表现"))]).alias("props")))
    edges = [shown.select(*node, F.lit(RELATED_SYMPTOM).alias("type"), "target", F.lit("").alias("dosage"), "ref", F.col("_at").alias("at"))]

    ends = _union(known)
    of = lambda end: ends.select(F.col("kind").alias(f"{end}_type"), F.col("ident").alias(f"{end}_ident"), F.col("node_type").alias(f"{end}_node_type"), F.col("node_name").alias(f"{end}_name"))
    told = relations.withColumn("source_ident", fold_key(F.col("source"))).withColumn("target_ident", fold_key(F.col("target"))).withColumn("ref", ref("relations"))
    told = told.join(of("source"), ["source_type", "source_ident"], "left").join(of("target"), ["target_type", "target_ident"], "left")
    shape = F.concat_ws("->", "source_type", "target_type", "edge_type")
    type_ = F.try_element_at(F.create_map(*[F.lit(x) for k, v in SHAPES.items() if v for x in ("->".join(k), v)]), shape)
    whole = F.col("source_name").isNotNull() & F.col("target_name").isNotNull()
    told = cut(told.withColumn("type", type_).withColumn("whole", whole), "told")  # names are folded and ends are found once
    meant = told.where(whole & F.col("type").isNotNull())
    dose = F.when(F.col("type") == SHAPES["formula", "herb", "contains"], nfc_strip(F.coalesce("dosage", F.lit("")))).otherwise("")
    edges.append(meant.select(F.col("source_node_type").alias("node_type"), F.col("source_name").alias("node_name"), "type", F.col("target_name").alias("target"), dose.alias("dosage"), "ref", F.struct("row_no", F.lit(0).alias("p"), F.lit(0).alias("i")).alias("at")))
    evidence.append(meant.select(F.col("source_node_type").alias("node_type"), F.col("source_name").alias("node_name"), "ref"))
    folded = cut(_union(edges).groupBy(*node, "type", "target").agg(F.min("dosage").alias("dosage"), F.max("dosage").alias("_other"), F.min_by("ref", "at").alias("ref"), F.count(F.lit(1)).alias("n")), "edges")
    if bad := folded.where(F.col("dosage") != F.col("_other")).limit(5).collect():
        raise BadInput(f"conflicting edge properties: {[(r.node_name, r.type, r.target, r.dosage, r['_other']) for r in bad]}")

    items = _union([strings(rows[t], t).withColumn("table", F.lit(t)) for t in FIELDS]).where("item <> ''").withColumnRenamed("row_no", "row")
    snomed = F.lower("item").startswith("snomed:") & (F.col("table") == "conditions")
    said = items.where(~snomed).join(_union(uses), ["table", "row", "field"]).select(*node, "list", F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("at")).alias("_o"), "item")
    once = said.unionByName(_union(names)).groupBy(*node, "list", "item").agg(F.min("_o").alias("_o"))
    lists = once.groupBy(*node, "list").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "item"))), lambda x: x["item"]).alias("items"))
    lists = lists.groupBy(*node).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "items")))).alias("lists"))
    none = F.array().cast("array<string>")
    nodes = _union(bags).join(lists, node, "left").select(*node, F.coalesce(F.try_element_at("lists", F.lit("aliases")), none).alias("aliases"), F.map_filter(F.coalesce("lists", F.create_map().cast("map<string,array<string>>")), lambda k, v: k != "aliases").alias("lists"), "props")

    held = judged.select(F.col("ident").alias("_i"), F.col("reason").alias("_why"))
    lost = told.where(~whole).join(held, F.col("source_ident") == F.col("_i"), "left")
    set_aside = _union([
        judged.where("reason IS NOT NULL").select(F.lit("condition").alias("what"), ref("conditions").alias("ref"), "reason"),
        found.where("reason IS NOT NULL").select(F.lit("manifestation").alias("what"), "ref", "reason"),
        lost.select(F.lit("relation").alias("what"), "ref", F.coalesce("_why", F.lit("missing_or_quarantined_endpoint")).alias("reason")),
        told.where(whole & F.col("type").isNull()).select(F.lit("relation").alias("what"), "ref", F.lit("no_neutral_formula_association_edge").alias("reason")),
    ])
    return {"nodes": nodes, "evidence": _union(evidence).distinct(), "edges": folded.drop("_other"), "set_aside": set_aside, "rows": rows, "units": grouped, "conditions": judged, "relations": told}


def report(cleaned: dict) -> DataFrame:
    """(section, what, n) of a cleaned source: rows, tags, identifiers, groups of one surface, relations, edges, repeats, names
    of both herbs and formulas, ends that were found under another spelling, and what was set aside."""
    count = F.count(F.lit(1)).alias("n")
    by = lambda rows, section, what: rows.groupBy(what.alias("what")).agg(count).select(F.lit(section).alias("section"), "what", "n")
    rows, judged, told, edges = cleaned["rows"], cleaned["conditions"], cleaned["relations"], cleaned["edges"]
    out = [by(r, "rows", F.lit(t)) for t, r in rows.items()] + [by(told, "relations", F.concat_ws("->", "source_type", "target_type", "edge_type")), by(judged, "tags", F.col("tag"))]
    out.append(by(judged.where("snomed_id IS NOT NULL"), "snomed", F.lit("all_with_id")))
    out.append(by(judged.where("reason IS NULL"), "snomed", F.when(F.col("snomed_id").isNotNull(), "accepted_with_id").otherwise("accepted_without_id")))
    for table, own in cleaned["units"].items():
        groups = own.where("size > 1").select("surface", "conflict").distinct()
        out.append(by(groups, "surfaces", F.concat(F.lit(f"{table}:"), F.when(F.col("conflict"), "conflict").otherwise("merged"))))
    out += [by(edges, "edges", F.col("type")), by(cleaned["set_aside"], "set_aside", F.concat_ws(":", "what", "reason"))]
    again = edges.groupBy(F.col("type").alias("what")).agg((F.sum("n") - F.count(F.lit(1))).alias("n")).where("n > 0")
    out.append(again.select(F.lit("collapsed").alias("section"), "what", "n"))
    out.append(by(rows["herbs"].select("ident").join(rows["formulas"].select("ident"), "ident", "left_semi"), "names", F.lit("herb_and_formula")))
    aliases = rows["herbs"].select("row_no", F.explode(F.try_variant_get("v_synonyms", "$", "array<string>")).alias("a")).where(has_han(F.col("a"))).select("row_no").distinct()
    out.append(by(aliases, "names", F.lit("chinese_alias_herb_rows")))
    ends = told.where("whole").select(F.explode(F.array(*[F.struct(F.col(e).alias("raw"), F.col(f"{e}_name").alias("name"), F.col(f"{e}_ident").alias("ident")) for e in ("source", "target")])).alias("e")).select("e.*").where("raw <> name")
    out.append(by(ends, "ends", F.when(fold_key(F.col("name")) == F.col("ident"), "other_case").otherwise("other_surface")))
    return _union(out)
