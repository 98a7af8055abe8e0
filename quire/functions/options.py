"""Options of a run as JSON: what a tool gets, what is kept, and what is only for the one who asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OWN = "@"  # keys of the interface begin with it


def entries(options: Column) -> Column:
    """Top-level keys and values (as JSON texts) of a JSON object; anything else has none."""
    keys = F.coalesce(F.json_object_keys(options), F.array().cast("array<string>"))
    values = F.from_json(options, "map<string,variant>")
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.to_json(F.element_at(values, k))))


def _kept(options: Column, keep) -> Column:
    pairs = F.array_sort(F.map_entries(F.map_filter(entries(options), keep)))
    listed = F.transform(pairs, lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p["key"])), r"^\[|\]$", ""), F.lit(":"), p["value"]))
    return F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))


def tool_options(options: Column) -> Column:
    """The JSON object without the interface's own keys, keys in order."""
    return _kept(options, lambda k, v: ~k.startswith(OWN))


def kept_options(options: Column) -> Column:
    """What may be remembered between runs: no key of the interface's own, and none that names a password."""
    return _kept(options, lambda k, v: ~k.startswith(OWN) & ~F.contains(F.lower(k), F.lit("password")))


def password(options: Column) -> Column:
    """The text under ``@password``; null if it is missing, empty or no text."""
    value = F.element_at(entries(options), OWN + "password")
    return F.when(value.startswith('"'), F.nullif(F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0)), F.lit("")))
