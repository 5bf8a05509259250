"""Column functions over names and sentences: white space, Unicode forms, surface keys, redaction, matching.

All but the Unicode normal forms, case folding and large-lexicon matching are built-in expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import BRANDS

# White space as str.strip() sees it, beyond what (?U)\s covers in Java.
WS = r"[\s\x1c-\x1f\x85]"
# The same, one by one.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Phrases that character recognition got wrong, with their corrections, applied in this order.
PHRASE_FIXES = [("置于燥", "置干燥"), ("置千燥", "置干燥"), ("置遁风", "置通风"), ("干燥赴", "干燥处"), ("鲜晶", "鲜品")]
# ASCII punctuation and its Chinese form in sentences.
ASCII_PUNCT, CN_PUNCT = ",;:.~", "，；：。～"
# Characters that a surface key ignores, besides white space.
SURFACE_IGNORED = "[　。．.，,、；;：:！!？?（）()【】\\[\\]“”\"'‘’《》〈〉·•\\-—_~～]"
# A Han character.
HAN = "[㐀-鿿]"
# Personal data and the marks that replace it, applied in this order.
PHONE = r"(?<![0-9])(?:1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8})(?![0-9])"
ID_CARD = r"(?<![0-9])[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9])"
ADMISSION = r"住院号[:：]?\s*[0-9]+"
APPROVAL = r"国药准字[A-Za-z0-9]+"
REDACTIONS = [(PHONE, "[已过滤电话]"), (ID_CARD, "[已过滤证件]"), (ADMISSION, "住院号[已过滤]"), (APPROVAL, "[已过滤批准文号]")]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def strip_ws(c: Column) -> Column:
    """Python's strip(): every Unicode space, not U+0020 alone."""
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def nfc_strip(c: Column) -> Column:
    """NFC and strip; text of ASCII alone is already in NFC and stays in the JVM."""
    return strip_ws(F.when(F.coalesce(c, F.lit("")).rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfc(c)))


def fold_key(c: Column) -> Column:
    """NFKC, strip and casefold: the stricter identity key of two sources."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^[\x20-\x7e]*$"), F.lower(F.trim(c))).otherwise(_nfkc_fold(c))


def phrase_fixes(c: Column) -> Column:
    for wrong, right in PHRASE_FIXES:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def surface_key(c: Column, unicode: bool = True) -> Column:
    """What two spellings of a term share: phrase fixes, NFC, no white space, no listed punctuation."""
    c = phrase_fixes(nfc_strip(c) if unicode else c)
    return F.regexp_replace(F.regexp_replace(c, rf"(?U){WS}+", ""), SURFACE_IGNORED, "")


def canonical_name(name: Column, label: Column, whole: dict[tuple[str, str], str]) -> Column:
    """A per-label map of whole names, tried on the raw name, then on the cleaned one, else the cleaned one."""
    clean = phrase_fixes(nfc_strip(name))
    if not whole:
        return clean
    at = F.create_map(*[F.lit(x) for (lab, wrong), right in whole.items() for x in (f"{lab}\x00{wrong}", right)])
    return F.coalesce(F.try_element_at(at, F.concat_ws("\x00", label, name)), F.try_element_at(at, F.concat_ws("\x00", label, clean)), clean)


def cn_punct(c: Column) -> Column:
    return F.translate(c, ASCII_PUNCT, CN_PUNCT)


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def redact(c: Column) -> Column:
    for pattern, mark in REDACTIONS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def pii_flags(c: Column) -> list[Column]:
    """has_phone, has_id_card, has_admission, has_email as 0 or 1."""
    c = F.coalesce(c, F.lit(""))
    return [c.rlike(p).cast("int").alias(n) for n, p in (("has_phone", PHONE), ("has_id_card", ID_CARD), ("has_admission", ADMISSION), ("has_email", EMAIL))]


def sex_age(c: Column) -> list[Column]:
    """First ``男|女 ... N岁`` of a case."""
    pattern = r"(男|女)[性]?[，,、\s]*([0-9]{1,3})\s*岁"
    return [F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("sex"), F.regexp_extract(c, pattern, 2).try_cast("int").alias("age")]


def alternation(terms: Iterable[str]) -> str:
    """A pattern that finds the longest of the terms at a place. Java and RE2 take the first that fits."""
    special = set("\\.[]{}()*+?^$|")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in t) for t in sorted(terms, key=lambda t: (-len(t), t)))


def lexicon_hits(c: Column, terms: Iterable[str]) -> Column:
    """Leftmost, longest, non-overlapping dictionary matches, distinct, in order of first sight. For some
    hundreds of terms; ``trie_hits`` takes any number."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(alternation(terms)), F.lit(0)))


def trie_hits(terms: Iterable[str]):
    """The same by a trie in a pandas UDF, for large lexicons: one walk over each text."""
    words = sorted(set(terms))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root: dict = {}
        for w in words:
            node = root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

        def scan(text: str | None) -> list[str] | None:
            if text is None:
                return None
            out, i, n = {}, 0, len(text)
            while i < n:
                node, j, best = root, i, None
                while j < n and (node := node.get(text[j])) is not None:
                    j += 1
                    best = node.get("", best)
                if best:
                    out.setdefault(best)
                    i += len(best)
                else:
                    i += 1
            return list(out)

        for batch in batches:
            yield batch.map(scan)

    return hits


def split_tokens(c: Column) -> Column:
    """Parts between Chinese and ASCII commas, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, "[，,、;；]"), strip_ws), lambda x: x != "")


def bracket_fields(c: Column, denied: tuple[str, ...] = ()) -> Column:
    """``【key】value`` pairs as a map, the last of equal keys; empty values and denied keys left out."""
    keys = F.regexp_extract_all(c, F.lit("【([^】]*)】([^【]*)"), F.lit(1))
    values = F.transform(F.regexp_extract_all(c, F.lit("【([^】]*)】([^【]*)"), F.lit(2)), strip_ws)
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: (p["v"] != "") & ~p["k"].isin(*denied) if denied else p["v"] != "")
    # of equal keys the last stays: later entries are looked for from behind
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def first_of(c: Column, *patterns: tuple[str, int]) -> Column:
    """The first pattern's group that is not empty."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, g), F.lit("")) for p, g in patterns])


def clip(c: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def parent_code(c: Column) -> Column:
    """``1.2.3`` to ``1.2``; null at the top."""
    return F.nullif(F.regexp_extract(c, r"^(.*)\.[^.]+$", 1), F.lit(""))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def strip_latin_lines(c: Column) -> Column:
    """Lines that hold a Han character or are blank; without outer line breaks; null if nothing is left."""
    kept = F.filter(F.split(c, "\n"), lambda x: x.rlike(HAN) | (strip_ws(x) == ""))
    return F.nullif(F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", ""), F.lit(""))


def contains_brand(c: Column) -> Column:
    return c.rlike("|".join(BRANDS))


def admin_id(label: Column, name: Column, stable: Column) -> Column:
    """``label:name[:stable]``."""
    return F.concat_ws(":", label, name, F.nullif(stable, F.lit("")))


def formula_warnings(name: Column) -> Column:
    """Reasons to doubt a formula's name: long with punctuation; two or more listed names that end as formulas do."""
    listed = F.filter(F.split(name, "[、和与及]"), lambda x: x.rlike("[汤丸散丹膏饮]"))
    return F.array_compact(F.array(F.when((F.length(name) > 8) & name.rlike("[。，.,；;：:！!？?]"), "descriptive_name"), F.when(F.size(listed) >= 2, "multiple_entities")))


def edge_id(given: Column, src: Column, rel: Column, dst: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.concat_ws(":", src, rel, dst))
