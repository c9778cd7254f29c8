"""The entity struct: a typed span of a text with its confidence and origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detection_method", T.StringType()),
        T.StructField("recognizer_name", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
ENTITIES = f"array<{ENTITY.simpleString()}>"
FIELDS = ENTITY.fieldNames()


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


def entity(entity_type, value: Column, start: Column, end: Column, confidence, method="regex", recognizer="", metadata: dict[str, Column] | None = None) -> Column:
    """An entity struct; metadata values become strings."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    facts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    fields = (lit(entity_type), value, start.cast("int"), end.cast("int"), lit(confidence).cast("double"), lit(method), lit(recognizer), facts.cast("map<string,string>"))
    return F.struct(*(x.alias(n) for n, x in zip(FIELDS, fields, strict=True)))


def replaced(e: Column, **fields: Column) -> Column:
    """The entity with some fields replaced."""
    return F.struct(*(fields.get(n, e[n]).alias(n) for n in FIELDS))


def with_metadata(e: Column, facts: dict[str, Column]) -> Column:
    """The entity with metadata added; a known key gets the new value."""
    new = F.create_map(*(x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))))
    old = F.map_filter(F.coalesce(e["metadata"], F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*facts))
    return replaced(e, metadata=F.map_concat(old, new))


def problems(e: Column) -> Column:
    """The rules that an entity breaks, as an array of names; empty if it is sound."""
    empty = lambda c: c.isNull() | (F.length(c) == 0)
    rules = {
        "start_pos": e["start_pos"].isNull() | (e["start_pos"] < 0),
        "end_pos": e["end_pos"].isNull() | (e["end_pos"] <= e["start_pos"]),
        "confidence": e["confidence"].isNull() | ~e["confidence"].between(0, 1),
        **{n: empty(e[n]) for n in ("entity_type", "value", "detection_method", "recognizer_name")},
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))


def length(e: Column) -> Column:
    return e["end_pos"] - e["start_pos"]
