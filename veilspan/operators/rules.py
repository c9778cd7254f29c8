"""The heuristic detector: loose patterns with plausibility checks, and names, addresses and organisations by their characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.entity import entity, no_entities
from ..functions.keywords import occurrences, runs, suffixed
from ..functions.spans import find_spans, window
from .tables import ADDRESS_WORDS, ORGANIZATION_WORDS, RULE_PATTERNS, SURNAMES

CJK = "一-龥"
CONFIDENCE = 0.8
_POSSESSIVE = ("的", "之")
_OTHER_NUMBER = re.compile("电话|手机|证件|身份|证号|卡号")
_WORDS = tuple(dict.fromkeys((*ADDRESS_WORDS, *ORGANIZATION_WORDS)))
_PLACE = {word: k for k, word in enumerate(_WORDS)}
_FOUND = pa.list_(pa.struct([("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def plausible_id(v: Column) -> Column:
    return v.rlike(r"^[0-9]{17}[0-9Xx]$") & F.substr(v, F.lit(7), F.lit(4)).try_cast("int").between(1900, 2024)


def plausible_bank_card(v: Column) -> Column:
    return F.length(v).between(13, 19) & ~checks.one_digit(v)


def near_postal_word(text: Column, s: Column) -> Column:
    return F.lower(window(text, s["start"], s["end"], 10)).rlike("邮编|邮政编码|zip|postal")


def _entities(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: entity(kind, s["value"], s["start"], s["end"], CONFIDENCE, "rule", f"{kind}_rule"))


def _named(text: str) -> list[tuple[int, int]]:
    """A surname with one to three characters, unless a possessive particle stands on either side."""
    found = (m.span() for m in re.finditer(f"[{SURNAMES}][{CJK}]{{1,3}}", text))
    return [(a, b) for a, b in found if text[a - 1 : a] not in _POSSESSIVE and text[b : b + 1] not in _POSSESSIVE]


def heuristic_spans(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of names, addresses and organisations: all their words are looked for at once, by one automaton."""
    out = [("PERSON_NAME", a, b) for a, b in _named(text)]
    places = occurrences(text, _WORDS)
    for kind, words, of, least, most in (("ADDRESS", ADDRESS_WORDS, f"[{CJK}\\d]", 2, 20), ("ORGANIZATION", ORGANIZATION_WORDS, f"[{CJK}\\w]", 2, 30)):
        within = runs(text, of) if places else ([], [])
        for word in words:
            for a, b in suffixed(places.get(_PLACE[word], []), len(word), within, least, most):
                if word == "号" and kind == "ADDRESS" and b < len(text) and _OTHER_NUMBER.search(text, a, b):
                    continue  # a number of something else, unless the text ends there
                if kind == "ADDRESS" or 3 <= b - a <= 30:
                    out.append((kind, a, b))
    return out


def _heuristics(texts: pa.Array) -> pa.Array:
    found = [[(t[a:b], a, b, kind) for kind, a, b in heuristic_spans(t)] if t else [] for t in texts.to_pylist()]
    return pa.array([[dict(zip(("value", "start", "end", "kind"), x, strict=True)) for x in own] for own in found], _FOUND)


def structured_entities(text: Column) -> Column:
    """The pattern part of the detector."""
    keep = {"ID_CARD": lambda s: plausible_id(s["value"]), "BANK_CARD": lambda s: plausible_bank_card(s["value"]), "POSTAL_CODE": lambda s: near_postal_word(text, s)}
    found = []
    for kind, pattern in RULE_PATTERNS.items():
        spans = find_spans(text, pattern)
        found.append(_entities(F.filter(spans, keep[kind]) if kind in keep else spans, kind))
    return F.concat(no_entities(), *found)


def rule_entities(text: Column) -> Column:
    """All heuristic hits; several keywords may give the same or overlapping ones. Texts without a CJK character skip the heuristics for them."""
    found = F.arrow_udf(_heuristics, "array<struct<value: string, start: int, end: int, kind: string>>")(F.when(text.rlike(f"[{CJK}]"), text))
    cjk = F.transform(found, lambda s: entity(s["kind"], s["value"], s["start"], s["end"], CONFIDENCE, "rule", F.concat(s["kind"], F.lit("_rule"))))
    return F.concat(structured_entities(text), cjk)


def with_rules(model: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Entities of a model and of the rules, one for each (key, type, value): the model's first, then the earliest; ``source`` tells whose."""
    both = model.withColumn("source", F.lit("model")).unionByName(rules.withColumn("source", F.lit("rule")), allowMissingColumns=True)
    order = Window.partitionBy(key, "entity_type", "value").orderBy(F.when(F.col("source") == "model", 0).otherwise(1), "start_pos")
    return both.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
