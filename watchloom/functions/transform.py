"""Functions that change an array, map or struct in place of the field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import snake
from .predicates import Value, col


def _present(args: tuple[Value, ...]) -> Column:
    out = F.lit(True)
    for a in args:
        out = out & col(a).isNotNull()
    return out


def _args(args: tuple[Value, ...]) -> Column:
    return F.array(*(col(a) for a in args))


def _or_empty(array: Column, like: Column) -> Column:
    return F.coalesce(array, F.slice(like, 1, 0))


def array_append(array: Column, *items: Value) -> Column:
    return F.when(_present(items), F.concat(_or_empty(array, _args(items)), _args(items)))


def array_append_any(array: Column, *items: Value) -> Column:
    found = F.array_compact(_args(items))
    return F.when(F.size(found) > 0, F.concat(_or_empty(array, found), found))


def array_append_unique(array: Column, *items: Value) -> Column:
    own = _or_empty(array, _args(items))
    return F.when(_present(items), F.concat(own, F.array_except(_args(items), own)))


def array_append_unique_any(array: Column, *items: Value) -> Column:
    found = F.array_compact(_args(items))
    own = _or_empty(array, found)
    return F.when(F.size(found) > 0, F.concat(own, F.array_except(found, own)))


def delete_key(obj: Column, key: str) -> Column:
    return F.map_filter(obj, lambda k, v: k != key)


def delete_fields_with_value(obj: Column, value: Value) -> Column:
    return F.map_filter(obj, lambda k, v: ~v.eqNullSafe(col(value)))


def erase_custom_fields(obj: Column, schema: list[str]) -> Column:
    return F.map_filter(obj, lambda k, v: k.isin(*schema))


def get_key_in(obj: Column, key: Value) -> Column:
    return F.try_element_at(obj, col(key))


def merge(field: Column, other: Column) -> Column:
    """Entries of both maps; those of other win."""
    mine = F.map_filter(field, lambda k, v: ~F.map_contains_key(other, k))
    return F.coalesce(F.map_concat(mine, other), field, other)


def merge_arrays(field: Column, other: Column) -> Column:
    """The field's elements, then those of other that it lacks."""
    return F.concat(field, F.array_except(other, field))


def merge_key_in(field: Column, obj: Column, key: Value) -> Column:
    return F.coalesce(merge(field, F.try_element_at(obj, col(key))), field)


def merge_recursive(field: Column, other: Column) -> Column:
    """Maps of maps: inner maps are merged entry by entry, those of other win."""
    inner = F.map_zip_with(field, other, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b)))
    return F.coalesce(inner, field, other)


def merge_recursive_key_in(field: Column, obj: Column, key: Value) -> Column:
    return F.coalesce(merge_recursive(field, F.try_element_at(obj, col(key))), field)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a column; an existing target is replaced."""
    return df.drop(new).withColumnRenamed(old, new) if old in df.columns else df


def replace(field: Column, old: str, new: str) -> Column:
    return F.replace(field, F.lit(old), F.lit(new))


def normalise_text(text: Column) -> Column:
    """Lower case, other signs as single underscores, none at the ends."""
    return F.btrim(snake(text), F.lit("_"))


def sanitize_fields(obj: Column, values_too: bool = False) -> Column:
    """Keys of a map in normal form (of equal keys the last wins); values_too for text values."""
    entries = F.transform(F.map_entries(obj), lambda e: F.struct(normalise_text(e["key"]).alias("key"), (normalise_text(e["value"]) if values_too else e["value"]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def split(array: Column, text: Column, character: str) -> Column:
    parts = F.split(text, "\\Q" + character + "\\E")
    return F.concat(_or_empty(array, parts), parts)


def trim(field: Column, where: str, character: str) -> Column:
    """where: begin, end or both."""
    return {"begin": F.ltrim, "end": F.rtrim, "both": F.btrim}[where](field, F.lit(character))


TRANSFORMS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        *(array_append, array_append_any, array_append_unique, array_append_unique_any, delete_key, delete_fields_with_value, erase_custom_fields, get_key_in),
        *(merge, merge_arrays, merge_key_in, merge_recursive, merge_recursive_key_in, rename, replace, sanitize_fields, split, trim),
    )
}
