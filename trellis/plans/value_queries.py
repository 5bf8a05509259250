"""Queries on small rules and ordered lists. Rows that the test tables lack are given as VALUES, to both engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.vocabulary import STATUSES
from ..operators import lists as L
from ..operators import segment as S
from .registry import query
from .views import GRAPH_SQL, nodes, table


def given(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: str) -> DataFrame:
    """p_partkey and one of the cases for every part, with the part's brand in place of @."""
    names = columns.split(", ")
    case = F.element_at(F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(names, row)]) for row in rows]), (F.col("p_partkey") % len(rows) + 1).cast("int"))
    told = table(spark, sf_dir, "part").select("p_partkey", "p_brand", case.alias("v"))
    return told.select("p_partkey", *[F.replace(F.col(f"v.{c}"), F.lit("@"), F.col("p_brand")).alias(c) for c in names])


def given_sql(rows: list[tuple], columns: str) -> str:
    """The same rows as the table t of a WITH clause."""
    quoted = lambda v: "NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(quoted, row))})" for i, row in enumerate(rows))
    return f"t AS (SELECT p_partkey, {', '.join(f"replace(v.{c}, '@', p_brand) AS {c}" for c in columns.split(', '))} FROM part JOIN (VALUES {values}) v(i, {columns}) ON p_partkey % {len(rows)} = v.i)"


NAMES = [("穴位", "合谷穴"), ("穴位", "合谷"), ("穴位", "穴"), ("药材", " 黄芪 "), ("药材", "合谷穴"), ("穴位", "  "), ("穴位", "@穴"), ("药材", " @ ")]


@query(f"""WITH {given_sql(NAMES, 'kind, name')}, s AS (SELECT *, trim(name) AS n FROM t)
SELECT p_partkey, kind, name, array_to_string(list_filter([n, CASE WHEN kind <> '穴位' THEN NULL WHEN n LIKE '%穴' THEN CASE WHEN length(n) > 1 THEN left(n, length(n) - 1) END ELSE n || '穴' END], lambda x: x <> ''), '|') AS names FROM s""")
def name_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, NAMES, "kind, name").select("p_partkey", "kind", "name", F.array_join(V.lookup_names(F.col("kind"), F.col("name")), "|").alias("names"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), b AS (SELECT *, regexp_replace(trim(line), '[\s\-‐‑–—·．.()（）,，/:：]+', '', 'g') AS bare FROM l),
c AS (SELECT *, length(bare) - length(regexp_replace(bare, '\p{L}', '', 'g')) AS letters FROM b)
SELECT doc_id, count_if(NOT regexp_matches(line, '[一-鿿]') AND length(bare) >= 3 AND letters >= greatest(3, floor(length(bare) * 0.8))) AS n_headers, count_if(regexp_matches(trim(line), '^[一-鿿]{2,20}$')) AS n_titles, count(*) AS n_lines FROM c GROUP BY doc_id""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like a Latin header or a short Chinese title, by document."""
    rows, line = S.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text"), F.col("line")
    return rows.groupBy("doc_id").agg(F.count_if(V.is_latin_header(line)).alias("n_headers"), F.count_if(V.is_short_han(line)).alias("n_titles"), F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT c_custkey, lower(c_mktsegment) || '-' || (c_custkey + 1) || '-' || replace(CASE WHEN c_custkey % 7 = 0 THEN 'item-' || (c_custkey + 1) ELSE c_name END, ' ', '-') AS item_key FROM customer""")
def review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.review_key(F.col("c_custkey"), F.col("c_mktsegment"), name).alias("item_key"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(translate(text, '：；' || chr(10), ':; '), '。', '。 '), '^\s+|\s+$', '', 'g'), ' {2,}', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def preview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(V.preview_text(F.col("text"))).alias("digest"))


TASTES = [("辛、甘，温。归肺经", "归脾、胃经。"), ("苦,寒。", "归心，肝,胆"), ("无味。", "无"), ("微苦、平", "归肾经、归"), ("@、辛，热。", "归@、肺。")]


@query(rf"""WITH {given_sql(TASTES, 'taste, course')}, p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(split_part(taste, '。', 1), '[、，,]'), lambda x: trim(x)), lambda x: x <> '') AS a,
  list_filter(list_transform(regexp_split_to_array(replace(CASE WHEN strpos(course, '归') > 0 THEN substr(course, strpos(course, '归') + 1) ELSE course END, '。', ''), '[、，,]'), lambda x: trim(x)), lambda x: x <> '') AS b FROM t)
SELECT p_partkey, taste, array_to_string(list_filter(a, lambda x: x IN ('辛', '甘', '苦', '酸', '咸', '淡', '涩')), '|') AS flavors, list_filter(a, lambda x: x IN ('寒', '热', '温', '凉', '平', '微寒', '微温'))[1] AS nature,
  array_to_string(list_transform(b, lambda x: CASE WHEN x LIKE '%经' THEN x ELSE x || '经' END), '|') AS meridians FROM p""")
def tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = given(spark, sf_dir, TASTES, "taste, course").withColumn("f", V.flavors_and_nature(F.col("taste")))
    return t.select("p_partkey", "taste", F.array_join("f.flavors", "|").alias("flavors"), F.col("f.nature").alias("nature"), F.array_join(V.meridians(F.col("course")), "|").alias("meridians"))


TAGS = [("气虚(Qi Def)", "SNOMED:123456|气虚"), ("血瘀", "snomed:0123456|瘀"), ("湿热(a)(B) ", "SNOMED:123456|SNOMED:654321"), ("(x) tail", "none"), ("痰(TAG)", "snomed:123456|SNOMED:123456"), ("痰@(Tag @)", "SNOMED:7654321|@")]


@query(rf"""WITH {given_sql(TAGS, 'name, aliases')}, s AS (SELECT *, list_distinct(list_transform(list_filter(string_split(aliases, '|'), lambda a: lower(a) LIKE 'snomed:%'), lambda a: regexp_extract(a, '^(?i:SNOMED):([1-9][0-9]{{5,17}})$', 1))) AS ids FROM t),
r AS (SELECT *, CASE WHEN list_contains(ids, '') THEN 'invalid_snomed_id' WHEN len(ids) > 1 THEN 'multiple_snomed_ids' END AS reason FROM s)
SELECT p_partkey, name, CASE WHEN regexp_matches(name, '\([^()]*\)\s*$') THEN lower(regexp_extract(name, '\(([^()]*)\)\s*$', 1)) ELSE '<none>' END AS tag, CASE WHEN reason IS NULL THEN ids[1] END AS id, reason FROM r""")
def condition_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = given(spark, sf_dir, TAGS, "name, aliases").withColumn("s", V.one_snomed(F.split("aliases", r"\|")))
    return t.select("p_partkey", "name", V.trailing_tag(F.col("name")).alias("tag"), "s.id", "s.reason")


ALIASES = [("黄芪|绵芪||黄芪", "北芪_x000D_ 口芪"), ("Radix|根", "radix"), ("", "当归"), ("|", None), ("黄@|当@", "当@_x000D_芪@|@")]


@query(rf"""WITH {given_sql(ALIASES, 'a, b')}, p AS (SELECT p_partkey, a, b, list_filter(list_transform(list_concat(regexp_split_to_array(coalesce(a, ''), '\|+|_x000D_\s*|[\r\n]+'), regexp_split_to_array(coalesce(b, ''), '\|+|_x000D_\s*|[\r\n]+')), lambda x: trim(x)), lambda x: x <> '' AND regexp_matches(x, '[㐀-鿿]')) AS k FROM t)
SELECT p_partkey, a, array_to_string(list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i), '|') AS aliases FROM p""")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, ALIASES, "a, b").select("p_partkey", "a", F.array_join(V.aliases_of(F.col("a"), F.col("b")), "|").alias("aliases"))


ENDS = [("方剂~桂枝汤_1",), ("方剂~ ",), ("无",), ("a~b~c",), (" 药材 ~ 桂枝 ",), ("方剂~@_12",), (" @ ~ 参@ ",)]


@query(rf"""WITH {given_sql(ENDS, 'raw')}, p AS (SELECT p_partkey, raw, list_transform(string_split(raw, '~'), lambda x: trim(x)) AS a FROM t), g AS (SELECT p_partkey, raw, CASE WHEN len(a) = 2 AND a[1] <> '' AND a[2] <> '' THEN a END AS a FROM p)
SELECT p_partkey, raw, a[1] AS kind, a[2] AS name, nullif(regexp_extract(a[2], '^(.+)_([0-9]+)$', 1), '') AS base FROM g""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = given(spark, sf_dir, ENDS, "raw").withColumn("e", V.endpoint(F.translate("raw", "~", "\t")))
    return e.select("p_partkey", "raw", "e.kind", "e.name", V.numbered_base(F.col("e.name")).alias("base"))


TOKENS = [("黄芪。",), ("注射用水",), ("等三种",), ("，当归，",), ("a",), ("同仁堂丸",), ("川芎（酒炙",), ("一二三四五六七八九十甲乙丙",), ("@参。",), ("，@（炒",)]


@query(f"""WITH {given_sql(TOKENS, 'token')}, s AS (SELECT p_partkey, token, regexp_replace(trim(token), '^[。；;，,、]+|[。；;，,、]+$', '', 'g') AS b FROM t)
SELECT p_partkey, token, CASE WHEN length(b) BETWEEN 2 AND 12 AND b NOT LIKE '%注射%' AND NOT (b LIKE '%等%' AND b LIKE '%种%') AND b NOT LIKE '%同仁堂%' THEN b END AS herb, token LIKE '%注射%' OR token LIKE '%同仁堂%' AS dropped, trim(regexp_replace(token, '[（(][^）)]*$', '')) AS open_tail FROM s""")
def herb_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, TOKENS, "token").select("p_partkey", "token", V.herb_token(F.col("token")).alias("herb"), V.bad_name(F.col("token")).alias("dropped"), V.open_tail(F.col("token")).alias("open_tail"))


TERMS = [("a", 0, "head"), ("a", 1, "2.1"), ("a", 2, "感冒@"), ("a", 3, "common cold"), ("a", 4, "因外感而发"), ("a", 5, " 的病 "), ("a", 6, "2.1.1"), ("a", 7, "指甲病"), ("a", 8, ""), ("a", 9, "指甲的病"), ("a", 10, "3.2"), ("a", 11, "3.3"), ("a", 12, "咳嗽@"), ("b", 0, "1.2"), ("b", 1, "注目@"), ("b", 2, "泛指看")]


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a book of one of two kinds, with its brand in place of @."""
    kinds = {k: F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(line).alias("line")) for p, n, line in TERMS if p == k]) for k in "ab"}
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.when(F.col("p_partkey") % 2 == 0, kinds["a"]).otherwise(kinds["b"])).alias("v"))
    return rows.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"), "p_partkey").alias("path"), "v.line_no", F.replace("v.line", F.lit("@"), F.col("p_brand")).alias("line"))


def books_sql() -> str:
    values = ", ".join(f"('{p}', {n}, '{line}')" for p, n, line in TERMS)
    return f"t AS (SELECT v.path || p_partkey AS path, line_no, replace(v.line, '@', p_brand) AS line FROM part JOIN (VALUES {values}) v(path, line_no, line) ON v.path = CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END)"


@query(rf"""WITH {books_sql()}, n AS (SELECT path, line_no, trim(line) AS line FROM t WHERE trim(line) <> ''), g AS (SELECT *, sum(regexp_matches(line, '^[0-9]+(?:\.[0-9]+)+$')::INT) OVER (PARTITION BY path ORDER BY line_no) AS term FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY path, term ORDER BY line_no) AS nth FROM g WHERE term > 0), d AS (SELECT *, max((nth > 2 AND regexp_matches(line, '^(因|泛指|与|指|临床|注)'))::INT) OVER (PARTITION BY path, term ORDER BY line_no) AS defined FROM r)
SELECT path, arg_min(line, line_no) AS code, string_agg(line, '|' ORDER BY line_no) FILTER (nth > 1 AND defined = 0) AS names, coalesce(string_agg(line, '' ORDER BY line_no) FILTER (defined = 1), '') AS definition FROM d GROUP BY path, term HAVING count_if(nth > 1 AND defined = 0) > 0""")
def numbered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.numbered_terms(books(spark, sf_dir), "path").select("path", "code", F.array_join("names", "|").alias("names"), "definition")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM f) AS total, 21 AS page, (SELECT count(*) FROM f) > 420 AS has_more FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 400""")
def verification_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a filtered list, with its number and what is behind it."""
    rows = L.filtered(table(spark, sf_dir, "orders"), {"o_orderstatus": "O", "o_orderpriority": None})
    found = L.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 400).select("o_orderkey", "o_totalprice")
    return found.crossJoin(F.broadcast(L.totals(rows, 20, 400).select("total", "page", "has_more")))  # one row


@query("""SELECT user_id, count(*) AS total, count_if(event_type <> 'view') AS unread FROM events GROUP BY user_id""")
def notification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unread_by_user(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "view")


@query("""SELECT event_id, ts, event_type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def newest_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest(L.filtered(table(spark, sf_dir, "events"), {"event_type": "purchase"}), "ts", "event_id", 20).select("event_id", "ts", "event_type")


@query("""WITH c AS (SELECT a.conv_id, a.turn, length(b.text) AS n_result, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn DESC) AS nth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, n_result::INT AS n_result, nth::INT AS nth FROM c WHERE nth <= 6""")
def last_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as a call, the assistant's next one as its return."""
    c, call = table(spark, sf_dir, "conversations"), lambda turn: F.concat_ws(":", "conv_id", turn)
    calls = c.where("role = 'user'").select("conv_id", "turn", call(F.col("turn")).alias("call_id"))
    returns = c.where("role = 'assistant'").select(call(F.col("turn") - 1).alias("call_id"), F.length("text").alias("n_result"))
    return L.last_calls(calls, returns, "conv_id", "turn").select("conv_id", "turn", "n_result", "nth")


@query("""SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (coalesce(text, '') <> '')::INT + (coalesce(lang, '') <> '')::INT DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def most_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.most_complete(table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang"), "source", ["text", "lang"], "doc_id").select("source", "doc_id")


FOLD_SQL = """e AS (SELECT l_partkey, l_suppkey, l_returnflag AS flag, l_orderkey || ':' || l_linenumber AS ref, l_orderkey * 10 + l_linenumber AS o FROM lineitem)"""


def _fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_partkey", "l_suppkey", F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("props"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence_ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))


@query(f"""WITH {FOLD_SQL} SELECT l_partkey, l_suppkey, min(flag) AS flag, string_agg(DISTINCT ref, ' || ' ORDER BY ref) AS evidence, count(*) AS n FROM e GROUP BY ALL HAVING min(flag) = max(flag)""")
def edge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal edges are one, with all evidence; those with other properties are conflicts."""
    good, _ = L.fold_edges(_fold_rows(spark, sf_dir), ["l_partkey", "l_suppkey"])
    return good.select("l_partkey", "l_suppkey", F.get_json_object("props_json", "$.flag").alias("flag"), "evidence", "n")


@query(f"""WITH {FOLD_SQL} SELECT l_partkey, l_suppkey, count(*) AS n FROM e GROUP BY ALL HAVING min(flag) <> max(flag)""")
def edge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fold_edges(_fold_rows(spark, sf_dir), ["l_partkey", "l_suppkey"])[1]


@query(f"""WITH {FOLD_SQL} SELECT l_partkey, l_suppkey, arg_min(ref, o) AS evidence FROM e GROUP BY ALL HAVING min(flag) = max(flag)""")
def edge_first_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As where a repeated edge keeps its first evidence."""
    return L.fold_edges(_fold_rows(spark, sf_dir), ["l_partkey", "l_suppkey"], keep_first=True)[0].select("l_partkey", "l_suppkey", "evidence")


@query(f"""WITH {GRAPH_SQL} SELECT id, CASE label WHEN 'supplier' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS rank, row_number() OVER (ORDER BY CASE label WHEN 'supplier' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END, name, id) AS place FROM nodes WHERE label IN ('region', 'nation', 'supplier')""")
def record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the rank of their kind, then by name."""
    from ..sources.sinks import numbered

    ranked = L.by_rank(nodes(spark, sf_dir).where("label IN ('region', 'nation', 'supplier')"), "label", ["supplier", "nation"], ["name", "id"])
    return numbered(ranked, ["rank", "name", "id"], "place").select("id", F.col("rank").cast("int").alias("rank"), F.col("place").cast("long").alias("place"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F'))) AS only_left, 0::BIGINT AS only_right""")
def union_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table's ids are those of two parts: here one status is in neither."""
    o = table(spark, sf_dir, "orders")
    return L.same_ids(o, o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), column="o_orderkey")


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS name FROM customer""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph merged with an expansion whose nodes replace those of the same id."""
    c = table(spark, sf_dir, "customer")
    return L.last_wins([c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("debt").alias("name"))], "id")


@query("""WITH r AS (SELECT CASE WHEN p_size < 5 THEN '来源' ELSE '药材' END AS t, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS e, p_size = 49 AS skip, p_type = 'SMALL' AS src FROM part)
SELECT count_if(src)::BIGINT AS source_edges, count_if(e <> '') AS fragment_records, count_if(skip OR t = '来源') AS omitted_records, count_if(NOT (skip OR t = '来源')) AS kept_records, count_if(NOT (skip OR t = '来源'))::BIGINT AS kept_edges FROM r""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, edge = table(spark, sf_dir, "part"), lambda t: F.struct(t.alias("type"))
    records = p.select(
        F.when(F.col("p_size") < 5, "来源").otherwise("药材").alias("node_type"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("evidence_text"),
        F.create_map(F.lit("skip_reason"), F.when(F.col("p_size") == 49, "no_clinical_knowledge").otherwise("")).alias("props"),
        F.filter(F.array(edge(F.lit("组成药材")), edge(F.when(F.col("p_type") == "SMALL", "来源于"))), lambda e: e["type"].isNotNull()).alias("edges"),
    )
    return L.store_counts(records, "来源于", "来源", "no_clinical_knowledge")


@query("""SELECT l_orderkey, l_linenumber, coalesce(l_discount * 10 > 0 AND l_discount * 10 <= 1, false) AS good FROM (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount IS NOT NULL)""")
def unit_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_discount IS NOT NULL").select("l_orderkey", "l_linenumber", V.in_unit_range((F.col("l_discount") * 10).cast("string")).alias("good"))


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '(nation|thing|that|the|und)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::INT AS n_parts FROM documents WHERE text IS NOT NULL""")
def entity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the entities that they name, longest first."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(V.segments_of(F.col("text"), ["the", "that", "nation", "thing", "und"])).alias("n_parts"))


@query("""SELECT 'part:' || p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'odd' END AS status FROM part""")
def frontend_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes under keys of either language."""
    k = F.col("p_size") % 3
    bag = F.create_map(F.lit("标识"), F.concat(F.lit("part:"), "p_partkey"), F.when(k == 1, "name").otherwise("名称"), F.col("p_name"), F.lit("状态"), F.when(k == 0, STATUSES["verified"]).when(k == 1, "").otherwise("odd"))
    return table(spark, sf_dir, "part").select(F.explode(F.array(V.frontend_node(bag, STATUSES))).alias("n")).select("n.*")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, round((epoch_us(ts) % 1000000) / 1000.0)::BIGINT AS ms FROM events""")
def tool_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON, times to the second, milliseconds since the second began."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(V.tool_payload(F.col("props")), "$.k").alias("k"), V.stamp(ts).alias("at"), V.elapsed_ms(F.date_trunc("second", ts), ts).alias("ms"))


CASES = [("王某，男，45岁，电话13812345678。", "头痛", None), ("例某", None, "住院号:123"), ("李某，@，电话13912345678", "@", None)]


@query(f"""WITH {given_sql(CASES, 'a, b, c')}, j AS (SELECT p_partkey, a, a || chr(10) || coalesce(b, '') || chr(10) || coalesce(c, '') AS x FROM t)
SELECT p_partkey, a, replace(regexp_replace(replace(replace(replace(x, '王某', '患者'), '李某', '患者'), '例某', '患者'), '13[89]12345678', '[已过滤电话]'), '住院号:123', '住院号[已过滤]') AS cleaned FROM j""")
def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, CASES, "a, b, c").select("p_partkey", "a", V.case_text(V.clinical_text(F.col("a"), F.col("b"), F.col("c"))).alias("cleaned"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_brand END AS snippet, coalesce(CASE WHEN p_size % 4 < 2 THEN 'part:' || p_partkey END, p_name) AS node_key, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS origin,
  CASE p_size % 4 WHEN 0 THEN 'sentence' WHEN 1 THEN 'book' WHEN 2 THEN 'term' END AS kind, p_name || ':' || p_partkey || '-' || p_size AS entry_key, 'manual:' || p_brand AS scope FROM part""")
def provenance_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-filled rules: snippet, node key, origin, kind of property, entry and scope keys."""
    m, none = F.col("p_size") % 4, F.lit("")
    bag = F.create_map(F.lit("snippet"), F.lit("  "), F.lit("raw_text"), F.when(m == 0, F.col("p_name")).otherwise(none), F.lit("原文"), F.when(m == 1, F.col("p_brand")).otherwise(none), F.lit("id"), F.when(m < 2, F.concat(F.lit("part:"), "p_partkey")).otherwise(none), F.lit("name"), F.col("p_name"), F.lit("import_source_id"), F.when(m % 2 == 0, F.col("p_brand")).otherwise(none))
    key = F.when(m == 0, "贮藏").when(m == 1, "source_book").when(m == 2, "主治").otherwise("name")
    return table(spark, sf_dir, "part").select("p_partkey", V.snippet(bag).alias("snippet"), V.node_key(bag).alias("node_key"), V.origin(bag, F.array("p_type")).alias("origin"), V.property_kind(key).alias("kind"), V.entry_key(F.col("p_name"), F.col("p_partkey"), F.col("p_size")).alias("entry_key"), V.scope_key(F.col("p_brand"), {"none": "x"}, "manual:").alias("scope"))
