"""Semi-structured columns: JSON texts as VARIANT and as maps. What doesn't parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(text: Column) -> Column:
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """The field at a path such as $.a.b[0] of a variant; null where it is missing or is of another kind."""
    return F.try_variant_get(value, path, kind)


def text_map(text: Column) -> Column:
    """The members of a JSON object as map<string, string>; null where it is none."""
    return F.from_json(text, "map<string,string>")


def renamed(m: Column, names: dict[str, str]) -> Column:
    """A map with some keys renamed; where that makes two of one, the first in the map stays."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.coalesce(F.try_element_at(pairs, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    first = F.aggregate(entries, F.slice(entries, 1, 0), lambda kept, e: F.when(F.exists(kept, lambda x: x["key"] == e["key"]), kept).otherwise(F.concat(kept, F.array(e))))
    return F.map_from_entries(first)


def schema_of(rows: DataFrame, column: str) -> DataFrame:
    """One row, the type that holds all variants of a column; merged by partial aggregates."""
    return rows.agg(F.schema_of_variant_agg(column).alias("schema"))
