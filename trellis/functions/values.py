"""Small rules on single values: names to look up, tags, tokens, defaults, keys. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bags import is_empty
from .text import REDACTIONS, has_han, strip_ws
from .vocabulary import BRANDS

# Properties whose values are matched as sentences, as book titles, as terms.
SENTENCE_KEYS = ("贮藏", "storage_text", "用法", "usage_text", "注意", "caution_text", "炮制方法", "processing_method_text", "说明", "description")
BOOK_KEYS = ("出处书名", "source_book")
TERM_KEYS = ("主治", "indications")
# Properties that a node is looked up by.
LOOKUP_KEYS = ("名称", "name", "别名", "alias", "aliases", "别名列表")
# Known flavours and natures.
FLAVORS = ("辛", "甘", "苦", "酸", "咸", "淡", "涩")
NATURES = ("寒", "热", "温", "凉", "平", "微寒", "微温")
# What a text snippet is read from, the first that is not blank.
SNIPPET_KEYS = ("snippet", "evidence_text", "证据原文", "raw_text", "原文")
# How the text of an entry begins.
BODY_PREFIXES = ("本品为", "本品由")
# Patterns.
TAG = r"\(([^()]*)\)\s*$"
SNOMED = r"^(?i:SNOMED):([1-9][0-9]{5,17})$"
ALIAS_BREAK = r"\|+|_x000D_\s*|[\r\n]+"
SURNAME = r"(?<!例)[一-鿿]{1,2}某"
HEADER_NOISE = r"[\s\-‐‑–—·．.()（）,，/:：]+"


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed; else null."""
    return F.coalesce(*[F.nullif(strip_ws(v), F.lit("")) for v in values])


def optional(value: Column) -> Column:
    """Empty to null, else text."""
    return F.nullif(value.cast("string"), F.lit(""))


def lookup_names(node_type: Column, name: Column) -> Column:
    """Names to try: the trimmed one, and of an acupoint the one with or without its suffix."""
    name = strip_ws(name)
    bare = F.when(F.length(name) > 1, F.left(name, F.length(name) - 1))
    other = F.when(node_type == "穴位", F.when(name.endswith("穴"), bare).otherwise(F.concat(name, F.lit("穴"))))
    return F.array_distinct(F.filter(F.array(name, other), lambda x: x.isNotNull() & (x != "")))


def han_values(bag: Column) -> Column:
    """Values of the lookup properties, in their order, that hold a Han character."""
    return F.filter(F.array(*[bag[k] for k in LOOKUP_KEYS]), lambda v: v.isNotNull() & has_han(v))


def known_by(bag: Column, names: Column) -> Column:
    """Whether a lookup property has one of the names."""
    return F.coalesce(F.arrays_overlap(F.filter(F.array(*[bag[k] for k in LOOKUP_KEYS]), lambda v: v.isNotNull()), names), F.lit(False))


def aliases_of(*texts: Column) -> Column:
    """Parts of all texts, cleaned, those with a Han character, each once by its folded form, in order of first sight."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(t, F.lit("")), ALIAS_BREAK) for t in texts]))
    kept = F.filter(F.transform(parts, strip_ws), lambda x: (x != "") & has_han(x))
    folded = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def endpoint(raw: Column) -> Column:
    """kind and name of "kind<tab>name"; null unless there is one tab between two parts that are not blank."""
    kind, name = (strip_ws(F.substring_index(raw, "\t", n)) for n in (1, -1))
    good = (F.length(raw) - F.length(F.replace(raw, F.lit("\t"), F.lit(""))) == 1) & (kind != "") & (name != "")
    return F.when(good, F.struct(kind.alias("kind"), name.alias("name")))


def trailing_tag(name: Column) -> Column:
    """What stands in parentheses at the end, in lower case, else ``<none>``."""
    return F.when(name.rlike(TAG), F.lower(F.regexp_extract(name, TAG, 1))).otherwise("<none>")


def one_snomed(aliases: Column) -> Column:
    """id and reason: the one identifier among the aliases; a reason where one is malformed or several differ."""
    tagged = F.filter(aliases, lambda a: F.lower(a).startswith("snomed:"))
    ids = F.array_distinct(F.transform(tagged, lambda a: F.regexp_extract(a, SNOMED, 1)))
    bad = F.array_contains(ids, "")
    reason = F.when(bad, "invalid_snomed_id").when(F.size(ids) > 1, "multiple_snomed_ids")
    return F.struct(F.when(reason.isNull(), F.get(ids, 0)).alias("id"), reason.alias("reason"))


def open_tail(name: Column) -> Column:
    """A name without a parenthesis that is never closed."""
    return strip_ws(F.regexp_replace(name, "[（(][^）)]*$", ""))


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[、，,]"), strip_ws), lambda x: x != "")


def flavors_and_nature(text: Column) -> Column:
    """Known flavours in order, and the first known nature, before the first full stop."""
    parts = _listed(F.substring_index(text, "。", 1))
    return F.struct(F.filter(parts, lambda x: x.isin(*FLAVORS)).alias("flavors"), F.get(F.filter(parts, lambda x: x.isin(*NATURES)), 0).alias("nature"))


def meridians(text: Column) -> Column:
    """Names behind the first 归, each with the suffix 经."""
    at = F.locate("归", text)
    rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)
    return F.transform(_listed(F.replace(rest, F.lit("。"), F.lit(""))), lambda x: F.when(x.endswith("经"), x).otherwise(F.concat(x, F.lit("经"))))


def preview_text(text: Column) -> Column:
    """Colons and semicolons of ASCII, a blank behind full stops, one blank for several and for line ends."""
    marked = F.replace(F.translate(text, "：；\n", ":; "), F.lit("。"), F.lit("。 "))
    return strip_ws(F.regexp_replace(strip_ws(marked), " {2,}", " "))


def review_key(position: Column, node_type: Column, name: Column) -> Column:
    """type-position-name with positions from 1 and blanks as dashes; an unnamed item is named by its position."""
    named = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("item-"), position + 1))
    return F.concat_ws("-", F.lower(F.coalesce(F.nullif(node_type, F.lit("")), F.lit("node"))), position + 1, F.replace(strip_ws(named), F.lit(" "), F.lit("-")))


def in_unit_range(text: Column) -> Column:
    """Whether a text is a decimal above 0 and up to 1; null where it is empty."""
    value = text.try_cast("decimal(20,10)")
    return F.when(~is_empty(text), F.coalesce((value > 0) & (value <= 1), F.lit(False)))


def rate(part: Column, whole: Column) -> Column:
    """A share, 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def elapsed_ms(first: Column, last: Column) -> Column:
    """Whole milliseconds between two times, at least 0."""
    return F.greatest(F.lit(0), F.round((F.unix_micros(last) - F.unix_micros(first)) / 1000)).cast("long")


def stamp(at: Column) -> Column:
    """UTC to the second, ISO."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def tool_payload(value: Column) -> Column:
    """JSON in one spelling where it parses, else the text itself."""
    return F.coalesce(F.to_json(F.from_json(value, "map<string,string>")), value)


def replaced(items: Column, old: str, new: str) -> Column:
    return F.transform(items, lambda x: F.when(x == old, new).otherwise(x))


def first_flat(paths: Column, n: int) -> Column:
    """Members of the first n lists, each once."""
    return F.array_distinct(F.flatten(F.slice(paths, 1, n)))


def scope_key(source: Column, known: dict[str, str], prefix: str) -> Column:
    """A source's own scope, else the prefix and the source."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), source) if known else F.lit(None).cast("string")
    return F.coalesce(own, F.concat(F.lit(prefix), source))


def case_text(text: Column) -> Column:
    """Surnames before 某 as 患者, then the marks for personal data."""
    text = F.regexp_replace(text, SURNAME, "患者")
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def clinical_text(*fields: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields])


def entry_key(title: Column, first: Column, last: Column) -> Column:
    return F.concat(title, F.lit(":"), first, F.lit("-"), last)


def is_short_han(line: Column) -> Column:
    """2 to 20 Han characters and nothing else."""
    return strip_ws(line).rlike("^[一-鿿]{2,20}$")


def is_latin_header(line: Column) -> Column:
    """No Han character; of three or more characters beside separators four fifths, and three, are letters."""
    bare = F.regexp_replace(strip_ws(line), HEADER_NOISE, "")
    letters = F.length(bare) - F.length(F.regexp_replace(bare, r"\p{L}", ""))
    return ~line.rlike("[一-鿿]") & (F.length(bare) >= 3) & (letters >= F.greatest(F.lit(3), F.floor(F.length(bare) * 0.8)))


def is_body(line: Column) -> Column:
    return strip_ws(line).startswith(BODY_PREFIXES[0]) | strip_ws(line).startswith(BODY_PREFIXES[1])


def around(text: Column, marker: str) -> Column:
    """The text before a marker line and what follows it; all of it and nothing if there is none."""
    at = F.locate(marker, text)
    return F.struct(F.when(at > 0, F.left(text, at - 1)).otherwise(text).alias("before"), F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise("").alias("behind"))


def property_kind(key: Column) -> Column:
    return F.when(key.isin(*SENTENCE_KEYS), "sentence").when(key.isin(*BOOK_KEYS), "book").when(key.isin(*TERM_KEYS), "term")


def snippet(bag: Column) -> Column:
    return first_filled(*[bag[k] for k in SNIPPET_KEYS])


def node_key(bag: Column) -> Column:
    return F.coalesce(*[F.nullif(bag[k], F.lit("")) for k in ("id", "标识", "name")])


def origin(bag: Column, listed: Column) -> Column:
    """The import source, else the first of the list of sources."""
    return F.coalesce(first_filled(bag["导入源"], bag["import_source_id"]), first_filled(F.get(listed, 0)))


def bad_name(name: Column) -> Column:
    """Whether a name is empty, of an injection or of a brand."""
    return F.coalesce(is_empty(name) | name.contains("注射") | name.rlike("|".join(BRANDS)), F.lit(True))


def herb_token(token: Column) -> Column:
    """A token without marks at its ends; null if it has under 2 or over 12 characters or is no herb's name."""
    bare = F.regexp_replace(strip_ws(token), "^[。；;，,、]+|[。；;，,、]+$", "")
    dropped = ~F.length(bare).between(2, 12) | bare.contains("注射") | (bare.contains("等") & bare.contains("种")) | bare.rlike("|".join(BRANDS))
    return F.when(~dropped, bare)


def kept_instruction(text: Column, keep: list[str], skip: list[str]) -> Column:
    return ~text.startswith("以下是") & ~text.isin(*skip) & text.isin(*keep)


def numbered_base(name: Column) -> Column:
    """What stands before ``_n``; null without it."""
    return F.nullif(F.regexp_extract(name, r"^(.+)_([0-9]+)$", 1), F.lit(""))


def frontend_node(bag: Column, statuses: dict[str, str]) -> Column:
    """id, name and status under either spelling of their keys; the status as shown to users, pending if none."""
    shown = F.create_map(*[F.lit(x) for k, v in statuses.items() for x in (v, k)])
    status = F.coalesce(F.nullif(bag["status"], F.lit("")), F.nullif(bag["状态"], F.lit("")))
    at = F.coalesce(bag["id"], bag["标识"])
    return F.when(at.isNotNull(), F.struct(at.alias("id"), F.coalesce(bag["name"], bag["名称"], F.lit("")).alias("name"), F.coalesce(F.try_element_at(shown, status), status, F.lit("pending")).alias("status")))


def segments_of(text: Column, names: list[str]) -> Column:
    """A text cut into the names it holds (longest first) and what lies between them, in order."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    escaped = "|".join("".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in n) for n in ordered)
    marked = F.regexp_replace(text, f"({escaped})", "\x00$1\x00")
    return F.filter(F.split(marked, "\x00"), lambda x: x != "")


