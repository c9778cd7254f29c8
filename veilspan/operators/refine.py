"""Reconciling entities: conflicts, overlaps, neighbours, context and false positives.

The functions on arrays keep a document's entities on its row, so a pipeline of them needs no shuffle and runs on
streams. ``resolve_rows`` and ``merge_adjacent_rows`` are the same on a row for each entity, with windows by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.entity import ENTITIES, ENTITY, length, no_entities, replaced, with_metadata
from ..functions.spans import let, occurrences, window
from ..functions.types import literal_map
from .tables import BLACKLIST, CONTEXT_KEYWORDS, METHOD_WEIGHTS, MERGEABLE, LEAST_LENGTH, PRIORITIES

_ONE = ENTITY.simpleString()
GAP = 2
OVERLAP = 0.3
CONTEXT_WIDTH = 20
VALIDATED_BELOW = 0.8
RAISED, LOWERED, LEAST_CONFIDENCE = 0.1, 0.2, 0.3


def score(e: Column) -> Column:
    """Confidence by the weight of its method, plus half of the type's priority in hundredths."""
    weight = F.coalesce(F.element_at(literal_map(METHOD_WEIGHTS), e["detection_method"]), F.lit(1.0))
    priority = F.coalesce(F.element_at(literal_map(PRIORITIES), e["entity_type"]), F.lit(0))
    return e["confidence"] * weight + priority / 100 * 0.5


def _ordered(entities: Column, *keys: Callable[[Column], Column]) -> Column:
    """Entities in order of the keys; ties keep the order of the array."""
    keyed = F.transform(entities, lambda e, i: F.struct(*(k(e).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), e.alias("e")))

    def compare(a: Column, b: Column) -> Column:
        out = F.when(a["i"] < b["i"], -1).otherwise(1)
        for n in reversed(range(len(keys))):
            x, y = a[f"k{n}"], b[f"k{n}"]
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return F.transform(F.array_sort(keyed, compare), lambda x: x["e"])


def resolve(entities: Column) -> Column:
    """Of each run of overlapping entities the one with the highest score, the earliest of equals."""
    state = f"struct<done: {ENTITIES}, best: {_ONE}, score: double, end: int>"

    def step(s: Column, e: Column) -> Column:
        mine = score(e)
        apart = s["best"].isNull() | (e["start_pos"] >= s["end"])
        better = apart | (mine > s["score"])
        return F.struct(
            F.when(apart & s["best"].isNotNull(), F.concat(s["done"], F.array(s["best"]))).otherwise(s["done"]).alias("done"),
            F.when(better, e).otherwise(s["best"]).alias("best"),
            F.when(better, mine).otherwise(s["score"]).alias("score"),
            F.when(apart, e["end_pos"]).otherwise(F.greatest(s["end"], e["end_pos"])).alias("end"),
        ).cast(state)

    start = F.struct(no_entities().alias("done"), F.lit(None).cast(_ONE).alias("best"), F.lit(0.0).alias("score"), F.lit(0).alias("end")).cast(state)
    ordered = _ordered(entities, lambda e: e["start_pos"], lambda e: e["end_pos"])
    return F.aggregate(ordered, start, step, lambda s: F.when(s["best"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["best"]))))


def merge_overlapping(entities: Column, least: float = OVERLAP) -> Column:
    """Entities, longest first at a start, absorb later ones that share enough of the shorter text with them.

    Only the first of a group absorbs, so groups don't chain; of a group the best stays: among one type the longest and then the most
    confident, among several types the most confident.
    """
    group = f"struct<head: {_ONE}, longest: {_ONE}, surest: {_ONE}, mixed: boolean>"

    def fits(head: Column, e: Column) -> Column:
        shared = F.least(head["end_pos"], e["end_pos"]) - F.greatest(head["start_pos"], e["start_pos"])
        return (shared > 0) & (shared >= F.lit(least) * F.least(length(head), length(e)))

    def absorbed(g: Column, e: Column) -> Column:
        old = g["longest"]
        longer = F.length(e["value"]) > F.length(old["value"])
        as_long = (F.length(e["value"]) == F.length(old["value"])) & (e["confidence"] > old["confidence"])
        return F.struct(
            g["head"].alias("head"),
            F.when(longer | as_long, e).otherwise(old).alias("longest"),
            F.when(e["confidence"] > g["surest"]["confidence"], e).otherwise(g["surest"]).alias("surest"),
            (g["mixed"] | (g["head"]["entity_type"] != e["entity_type"])).alias("mixed"),
        ).cast(group)

    def step(groups: Column, e: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: fits(g["head"], e)), F.lit(True))
        new = F.struct(e.alias("head"), e.alias("longest"), e.alias("surest"), F.lit(False).alias("mixed")).cast(group)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, absorbed(g, e)).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(new)))

    ordered = _ordered(entities, lambda e: e["start_pos"], lambda e: -F.length(e["value"]))
    groups = F.aggregate(ordered, F.array().cast(f"array<{group}>"), step)
    return F.transform(groups, lambda g: F.when(g["mixed"], g["surest"]).otherwise(g["longest"]))


def _chained(a: Column, b: Column) -> Column:
    gap = b["start_pos"] - a["end_pos"]
    return (a["entity_type"] == b["entity_type"]) & a["entity_type"].isin(*MERGEABLE) & gap.between(0, GAP)


def merge_adjacent(entities: Column) -> Column:
    """Chains of neighbours of one mergeable type, at most two characters apart, become one entity.

    Its value is the values joined without what lies between them, its confidence their mean.
    """
    state = f"struct<done: {ENTITIES}, chain: {ENTITIES}>"

    def combined(chain: Column) -> Column:
        first, last = chain[0], F.element_at(chain, -1)
        confidences = F.transform(chain, lambda e: e["confidence"])
        mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(chain)
        out = replaced(first, value=F.array_join(F.transform(chain, lambda e: e["value"]), ""), end_pos=last["end_pos"], confidence=mean)
        facts = {"merged_from": F.size(chain), "source_confidences": F.to_json(confidences)}
        return F.when(F.size(chain) > 1, with_metadata(out, facts)).otherwise(first)

    def closed(s: Column) -> Column:
        return F.when(F.size(s["chain"]) > 0, F.concat(s["done"], F.array(combined(s["chain"])))).otherwise(s["done"])

    def step(s: Column, e: Column) -> Column:
        goes_on = (F.size(s["chain"]) > 0) & F.coalesce(_chained(F.try_element_at(s["chain"], F.lit(-1)), e), F.lit(False))
        return F.struct(F.when(goes_on, s["done"]).otherwise(closed(s)).alias("done"), F.when(goes_on, F.concat(s["chain"], F.array(e))).otherwise(F.array(e)).alias("chain")).cast(state)

    start = F.struct(no_entities().alias("done"), no_entities().alias("chain"))
    return F.aggregate(_ordered(entities, lambda e: e["start_pos"]), start, step, closed)


def merge(entities: Column, overlapping: bool = True, adjacent: bool = True) -> Column:
    if overlapping:
        entities = merge_overlapping(entities)
    if adjacent:
        entities = merge_adjacent(entities)
    return _ordered(entities, lambda e: e["start_pos"])


def context_score(e: Column, text: Column) -> Column:
    """(positive - negative) / (positive + negative) keyword occurrences around the entity; 0 without any, null for types without keywords."""
    def counted(near: Column) -> Column:
        out = F.lit(None).cast("struct<p: int, n: int>")
        for kind, words in CONTEXT_KEYWORDS.items():
            p, n = (occurrences(near, tuple(w.lower() for w in words[side])) for side in ("positive", "negative"))
            out = F.when(e["entity_type"] == kind, F.struct(p.alias("p"), n.alias("n"))).otherwise(out)
        return out

    def balance(c: Column) -> Column:
        both = c["p"] + c["n"]
        return F.when(c.isNotNull(), F.when(both > 0, (c["p"] - c["n"]) / both).otherwise(0.0))

    # the window and the counts are computed once each; an expression that names them again would compute them again
    near = F.lower(window(text, e["start_pos"], e["end_pos"], CONTEXT_WIDTH))
    return let(let(near, counted), balance)


def validate_context(entities: Column, text: Column, below: float = VALIDATED_BELOW) -> Column:
    """Raise or lower confidences under ``below`` by their context, and drop those that end at 0.3 or less."""

    def judged(e: Column) -> Column:
        def adjusted(s: Column) -> Column:
            new = F.when(s > 0, e["confidence"] + s * RAISED).when(s < 0, e["confidence"] - F.abs(s) * LOWERED).otherwise(e["confidence"])
            new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), new))
            facts = {"context_score": s, "original_confidence": e["confidence"]}
            return F.when(new > LEAST_CONFIDENCE, with_metadata(replaced(e, confidence=new), facts))

        known = e["entity_type"].isin(*CONTEXT_KEYWORDS)
        return F.when((e["confidence"] < below) & known, let(context_score(e, text), adjusted)).otherwise(e)

    return F.array_compact(F.transform(entities, judged))


def blacklisted(e: Column) -> Column:
    value = F.trim(F.lower(e["value"]))
    out = F.lit(False)
    for kind, entries in BLACKLIST.items():
        hit = value.isin(*entries)
        for part in entries:
            if part.endswith("@") or part.endswith(".com"):
                hit = hit | value.contains(part)
        out = out | ((e["entity_type"] == kind) & hit)
    return out


def implausible(e: Column) -> Column:
    """Values of one digit, of a run of digits, or that only stand for something."""
    kind, value = e["entity_type"], e["value"]
    digits = checks.digits_only(value)
    return (
        F.when(kind == "PHONE_NUMBER", checks.one_digit(digits) | checks.sequential(digits))
        .when(kind == "POSTAL_CODE", value.isin("000000", "999999") | checks.one_digit(value))
        .when(kind.isin("ID_CARD", "BANK_CARD"), checks.few_digits(value))
        .when(kind == "IP_ADDRESS", value.isin("127.0.0.1", "0.0.0.0", "localhost"))
        .otherwise(False)
    )


def malformed(e: Column) -> Column:
    kind, value = e["entity_type"], e["value"]
    digits = checks.digits_only(value)
    return (
        F.when(kind == "BANK_CARD", ~checks.luhn(digits, 13, 64))
        .when(kind == "ID_CARD", (F.length(value) == 18) & ~checks.id_checksum(value))
        .when(kind == "EMAIL", ~value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
        .when(kind == "PHONE_NUMBER", (F.length(digits) == 11) & ~digits.startswith("1"))
        .otherwise(False)
    )


def too_short(e: Column) -> Column:
    bare = F.regexp_replace(e["value"], r"[-\s()]", "")
    least = F.element_at(literal_map(LEAST_LENGTH), e["entity_type"])
    size = F.when(e["entity_type"].isin("PHONE_NUMBER", "ID_CARD", "BANK_CARD"), F.length(bare)).otherwise(F.length(e["value"]))
    return F.coalesce(size < least, F.lit(False))


def drop_false_positives(entities: Column, blacklist: bool = True, statistics: bool = True, formats: bool = True) -> Column:
    def sound(e: Column) -> Column:
        out = ~too_short(e)
        for wanted, bad in ((blacklist, blacklisted), (statistics, implausible), (formats, malformed)):
            out = out & ~bad(e) if wanted else out
        return out

    return F.filter(entities, sound)


def refine(rows: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """Resolve, merge, validate by context and filter the entities of each row. Each step is a projection of its own, so
    that none is computed twice."""
    rows = rows.withColumn(entities, resolve(F.col(entities)))
    rows = rows.withColumn(entities, merge(F.col(entities)))
    rows = rows.withColumn(entities, validate_context(F.col(entities), F.col(text)))
    return rows.withColumn(entities, drop_false_positives(F.col(entities)))


def resolve_rows(each: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """``resolve`` on a row for each entity: overlap runs by a running maximum, then the first by score."""
    by_place = Window.partitionBy(key).orderBy("start_pos", "end_pos", order)
    before = F.max("end_pos").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = each.withColumn("__new", (before.isNull() | (F.col("start_pos") >= before)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(by_place)).withColumn("__score", score(F.struct(*each.columns)))
    best = Window.partitionBy(key, "__run").orderBy(F.col("__score").desc(), "start_pos", "end_pos", order)
    return runs.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").select(*each.columns)


def merge_adjacent_rows(each: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """``merge_adjacent`` on a row for each entity: (key, entity_type, value, start_pos, end_pos, confidence, merged_from)."""
    by_place = Window.partitionBy(key).orderBy("start_pos", order)
    gap = F.col("start_pos") - F.lag("end_pos").over(by_place)
    goes_on = (F.lag("entity_type").over(by_place) == F.col("entity_type")) & F.col("entity_type").isin(*MERGEABLE) & gap.between(0, GAP)
    chains = each.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("__chain", F.sum("__new").over(by_place))
    part = F.array_sort(F.collect_list(F.struct("start_pos", order, "value")))
    last = F.max_by("end_pos", F.struct("start_pos", order))
    out = chains.groupBy(key, "__chain").agg(F.first("entity_type").alias("entity_type"), part.alias("__parts"), F.min("start_pos").alias("start_pos"), last.alias("end_pos"), F.avg("confidence").alias("confidence"), F.count("*").cast("int").alias("merged_from"))
    return out.select(key, "entity_type", F.array_join("__parts.value", "").alias("value"), "start_pos", "end_pos", "confidence", "merged_from")
