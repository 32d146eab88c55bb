"""Columns over open JSON (VARIANT): path access, first non-empty value, truthiness, canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON texts that count as false: null, empty string, zero, false, empty array and object.
FALSY = ('""', "0", "0.0", "-0.0", "false", "[]", "{}", "null")


def parsed_once(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The same rows, their payload computed once for all that refers to it above: it comes out of a generator, which no filter is pushed through."""
    return df.select(*(F.explode(F.array(raw)).alias(raw) if c == raw else F.col(c) for c in df.columns))


def get(raw: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path; null where a step is absent or not an object, or the type doesn't fit."""
    return F.try_variant_get(raw, "$." + path if path else "$", kind)


def canonical(v: Column) -> Column:
    """JSON text with sorted keys: equal for equal payloads, so it can be grouped and compared."""
    return F.to_json(v)


def present(raw: Column, path: str) -> Column:
    """The key exists, even with JSON null."""
    return get(raw, path).isNotNull()


def truthy(v: Column) -> Column:
    return v.isNotNull() & ~F.to_json(v).isin(*FALSY)


def filled(v: Column) -> Column:
    """Neither null, JSON null nor the empty string; 0 and false count as filled."""
    return v.isNotNull() & ~F.is_variant_null(v) & (F.coalesce(text(v), F.lit("-")) != "")


def first_value(raw: Column, *paths: str) -> Column:
    """First filled value along the paths, as VARIANT."""
    return F.coalesce(*(F.when(filled(get(raw, p)), get(raw, p)) for p in paths))


def first_truthy(raw: Column, *paths: str) -> Column:
    return F.coalesce(*(F.when(truthy(get(raw, p)), get(raw, p)) for p in paths))


def first_string(raw: Column, *paths: str) -> Column:
    """First value along the paths that is a JSON string and not blank; other types are passed over."""
    return F.coalesce(*(F.when(is_string(get(raw, p)) & (F.trim(text(get(raw, p))) != ""), text(get(raw, p))) for p in paths))


def kind(v: Column) -> Column:
    """The type of a variant value, as the engine's schema text begins with it."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return v.isNotNull() & (kind(v) == "STRING")


def is_object(v: Column) -> Column:
    return v.isNotNull() & kind(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return v.isNotNull() & kind(v).startswith("ARRAY")


def text(v: Column) -> Column:
    """The value as plain text: strings without quotes, anything else as JSON."""
    return F.try_variant_get(v, "$", "string")


def items(v: Column) -> Column:
    """The elements of an array value; an empty array for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
