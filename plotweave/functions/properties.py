"""Properties: array<struct<key string, tag tinyint, value variant>>, in insertion order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TYPE = "array<struct<key:string,tag:tinyint,value:variant>>"
#: Value types by tag (fixed values of the data model) and the Spark type of each.
TAGS = ("bool", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "bytes", "string", "vec", "map")
SPARK_TYPES = ("boolean", "tinyint", "smallint", "smallint", "int", "int", "bigint", "bigint", "decimal(20,0)", "float", "double", "binary", "string", "variant", "variant")
_BY_TYPE = {"boolean": 0, "tinyint": 1, "smallint": 3, "int": 5, "bigint": 7, "float": 9, "double": 10, "binary": 11, "string": 12}


def entry(key: str, value: Column, kind: str) -> Column:
    """One property; `kind` is one of TAGS or the name of a Spark type."""
    tag = TAGS.index(kind) if kind in TAGS else _BY_TYPE[kind]
    variant = value if SPARK_TYPES[tag] == "variant" else F.to_variant_object(F.array(value.cast(SPARK_TYPES[tag])))
    if SPARK_TYPES[tag] != "variant":
        variant = F.variant_get(variant, "$[0]", "variant")
    return F.struct(F.lit(key).alias("key"), F.lit(tag).cast("tinyint").alias("tag"), variant.alias("value"))


def empty() -> Column:
    return F.expr(f"cast(array() as {TYPE})")


def of(*entries: Column) -> Column:
    return F.array(*entries) if entries else empty()


def keys(props: Column) -> Column:
    return F.transform(props, lambda p: p["key"])


def has(props: Column, key: str) -> Column:
    return F.array_contains(keys(props), key)


def get(props: Column, key: str, kind: str) -> Column:
    """The value as a Spark type; NULL if the key is missing or the value is of another kind."""
    hit = F.get(F.filter(props, lambda p: p["key"] == F.lit(key)), F.lit(0))
    return F.try_variant_get(hit["value"], "$", kind)


def tag(props: Column, key: str) -> Column:
    return F.get(F.filter(props, lambda p: p["key"] == F.lit(key)), F.lit(0))["tag"]


def insert(props: Column, new: Column) -> Column:
    """Appends an entry; a key that is there already is an error."""
    doubled = F.array_contains(keys(props), new["key"])
    return F.when(doubled, F.raise_error(F.concat(F.lit("property exists: "), new["key"])).cast(TYPE)).otherwise(F.array_append(props, new))


def is_empty(props: Column) -> Column:
    return F.size(props) == 0


def same(a: Column, b: Column) -> Column:
    """Equal keys, types and values in the same order. Variants don't compare, so their JSON texts do."""
    return to_json_entries(a).eqNullSafe(to_json_entries(b))


def from_json_entries(entries: Column) -> Column:
    """From array<struct<key, tag, json>> (values as JSON texts): the same with variant values."""
    return F.transform(entries, lambda p: F.struct(p["key"].alias("key"), p["tag"].cast("tinyint").alias("tag"), F.try_parse_json(p["json"]).alias("value")))


def to_json_entries(props: Column) -> Column:
    return F.transform(props, lambda p: F.struct(p["key"].alias("key"), p["tag"].alias("tag"), F.to_json(p["value"]).alias("json")))
