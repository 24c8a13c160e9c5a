"""Index keys: one string per (name, value), equality is all they are used for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_key(name: Column | str, value: Column | str) -> Column:
    """``name:value``; the colon is not escaped, so ("a:b", "c") and ("a", "b:c") are one key."""
    name = F.lit(name) if isinstance(name, str) else name
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(name, F.lit(":"), value)


def index_keys(indexes: Column) -> Column:
    """All keys of an index map, one per entry; an entry without a value has none, nor has a null map."""
    return F.transform(F.filter(F.map_entries(indexes), lambda e: e["value"].isNotNull()), lambda e: index_key(e["key"], e["value"]))


def key_name(key: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(key, ":", 1)


def key_value(key: Column) -> Column:
    """What stands after the first colon."""
    return F.substring(key, F.length(key_name(key)) + 2, F.length(key))


def indexes_of(keys: Column) -> Column:
    """The name-to-value map of a list of keys; of keys with the same name the last one counts."""
    parts = F.transform(keys, lambda k: F.struct(key_name(k).alias("key"), key_value(k).alias("value")))
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def unsigned_32(ts: Column) -> Column:
    """A timestamp as a 32-bit unsigned field would give it back."""
    return ts.bitwiseAND(F.lit(0xFFFFFFFF))


def bucket_of(space: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(space), F.lit(buckets)).cast("int")
