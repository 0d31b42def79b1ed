"""Optional tags XX:T:value of graph and alignment lines, as a map from tag to (type, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "map<string,struct<type:string,value:string>>"


def parse(parts: Column) -> Column:
    """An array of 'XX:T:value' as a map; what is no tag is left out, of repeated tags the last stays."""
    good = F.filter(parts, lambda p: p.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    one = F.transform(good, lambda p: F.struct(F.substring(p, 1, 2).alias("key"), F.struct(F.substring(p, 4, 1).alias("type"), p.substr(F.lit(6), F.length(p)).alias("value")).alias("value")))
    last = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    unique = lambda all_: F.size(F.array_distinct(F.transform(all_, lambda x: x["key"]))) == F.size(all_)
    # an array of one holds the entries, so that they are made once and not for each use
    return F.map_from_entries(F.transform(F.array(one), lambda all_: F.when(unique(all_), all_).otherwise(last(all_)))[0])


def render(tags: Column) -> Column:
    """The map as an array of 'XX:T:value' in order of the tags."""
    entries = F.sort_array(F.transform(F.map_entries(tags), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])))
    return F.coalesce(entries, F.array().cast("array<string>"))


def get(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))["value"]


def drop(tags: Column, *keys: str) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys))


def put(tags: Column, key: str, kind: str, value: Column) -> Column:
    """tags with this tag set, whether it was there or not."""
    new = F.map_from_arrays(F.array(F.lit(key)), F.array(F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))
    return F.map_concat(drop(F.coalesce(tags, F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<type:string,value:string>>>"))), key), new)
