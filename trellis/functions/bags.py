"""Property bags: maps of strings with one meaning of "empty" (null or '')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import FRAGMENT_KEYS, STABLE_ID_KEYS

BAG = T.MapType(T.StringType(), T.StringType())


def is_empty(v: Column) -> Column:
    return v.isNull() | (v == "")


def non_empty(bag: Column) -> Column:
    return F.map_filter(bag, lambda k, v: ~is_empty(v))


def allow(bag: Column, keys: list[str]) -> Column:
    """Allow-listed, non-empty entries."""
    return F.map_filter(bag, lambda k, v: k.isin(keys) & ~is_empty(v))


def deny(bag: Column, keys: list[str]) -> Column:
    return F.map_filter(bag, lambda k, v: ~k.isin(keys))


def fill_if_empty(existing: Column, incoming: Column, protected: list[str] = ()) -> Column:
    """Incoming values where the existing one is empty; protected keys keep theirs (or stay absent)."""
    free = deny(incoming, list(protected)) if protected else incoming
    both = F.map_zip_with(existing, free, lambda k, a, b: F.when(is_empty(a), b).otherwise(a))
    return non_empty(both)


def rename_keys(bag: Column, names: dict[str, str], drop_unmapped_ascii: bool = False) -> Column:
    """Keys by a dictionary, others as they are; optionally without unmapped keys of ASCII alone."""
    if not names:
        return bag
    at = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    if drop_unmapped_ascii:
        bag = F.map_filter(bag, lambda k, v: F.map_contains_key(at, k) | ~k.rlike(r"^[\x00-\x7f]+$"))
    return F.transform_keys(bag, lambda k, v: F.coalesce(F.try_element_at(at, k), k))


def look_up(value: Column, names: dict[str, str]) -> Column:
    """A dictionary with unknown values passed through."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def sorted_json(bag: Column) -> Column:
    """One text for equal bags: keys in order, no blanks."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(bag))))


def ordered_union(*arrays: Column) -> Column:
    """Distinct members in order of first sight."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def stable_id(bag: Column, keys: tuple[str, ...] = STABLE_ID_KEYS) -> Column:
    """The first identifying property that is not empty, else ''."""
    return F.coalesce(*[F.nullif(bag[k], F.lit("")) for k in keys], F.lit(""))


def for_graph(bag: Column) -> Column:
    """Without text fragments and empty values."""
    return non_empty(deny(bag, list(FRAGMENT_KEYS)))


def without_latin(bag: Column) -> Column:
    """Without pinyin and Latin names; an alias stays if it holds a Han character."""
    kept = deny(bag, ["pinyin_name", "latin_name", "拼音", "拉丁名"])
    return F.map_filter(kept, lambda k, v: ~k.isin("alias", "aliases", "别名", "别名列表") | v.rlike("[㐀-鿿]"))
