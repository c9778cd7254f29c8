"""Detection in which a hostile pattern costs its own hits and not the job.

A pattern with a repeat within a repeat, alternatives within one, or a reference back can take exponential time, or a stack frame for each repeat, on a text
that almost matches. Such patterns are told apart before the job runs; they are searched in an Arrow stage by an engine that gives up after a
budget, and a text that exhausts it is named in quarantine. All others stay expressions.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entity import no_entities
from ..functions.spans import find_spans
from .detect import Registry
from .recognizers import Recognizer

#: Seconds that a pattern may take for a text.
BUDGET = 1.0
#: Repeats from this number on count as unbounded.
MANY = 1000
_SPANS = "struct<spans: array<struct<value: string, start: int, end: int>>, failed: boolean>"
_ARROW = pa.struct([("spans", pa.list_(pa.struct([("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("failed", pa.bool_())])


def hazards(pattern: str) -> list[str]:
    """What may make a pattern backtrack without end; empty if nothing does."""
    found: list[str] = []

    def walk(items, repeated: bool) -> None:
        for kind, arg in items:
            if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                unbounded = arg[1] is sre.MAXREPEAT or arg[1] >= MANY
                if unbounded and repeated:
                    found.append("a repeat within a repeat")
                walk(arg[2], repeated or unbounded)
            elif kind is sre.BRANCH:
                if repeated:
                    found.append("alternatives within a repeat")
                for part in arg[1]:
                    walk(part, repeated)
            elif kind is sre.SUBPATTERN:
                walk(arg[-1], repeated)
            elif kind in (sre.ASSERT, sre.ASSERT_NOT):
                walk(arg[1], repeated)
            elif kind in (sre.GROUPREF, sre.GROUPREF_EXISTS):
                found.append("a reference back")
                if kind is sre.GROUPREF_EXISTS:
                    for part in arg[1:]:
                        walk(part or (), repeated)

    walk(parser.parse(pattern), False)
    if re.search(r"\|[^()]*\)(?:[*+]|\{[0-9]+,\})", pattern):  # of single characters the parser makes a class, but executors don't
        found.append("alternatives within a repeat")
    return list(dict.fromkeys(found))


def _guarded(pattern: str, budget: float) -> Callable[[pa.Array], pa.Array]:
    def find(texts: pa.Array) -> pa.Array:
        import regex

        search, out = regex.compile(pattern), []
        for text in texts.to_pylist():
            spans, failed = [], False
            try:
                for m in search.finditer(text, timeout=budget) if text else ():
                    spans.append({"value": m[0], "start": m.start(), "end": m.end()})
            except (TimeoutError, MemoryError, RecursionError):
                spans, failed = [], True
            out.append({"spans": spans, "failed": failed})
        return pa.array(out, _ARROW)

    return find


def guarded_spans(text: Column, pattern: str, budget: float = BUDGET) -> Column:
    """(spans, failed): the matches of a pattern as ``find_spans`` has them, or none and true for a text that takes longer than ``budget`` seconds."""
    re.compile(pattern)
    return F.arrow_udf(_guarded(pattern, budget), _SPANS)(text)


def detect_isolated(docs: DataFrame, registry: Registry | None = None, text: str = "text", entity_types: Iterable[str] | None = None, budget: float = BUDGET, into: str = "entities", quarantine: str = "quarantined") -> DataFrame:
    """``detect``, with hazardous patterns under a budget; ``quarantine`` lists the recognizers that a text was too much for. Their other patterns' hits stay."""
    chosen = (registry or Registry.default()).chosen(entity_types)
    names: dict[tuple[str, str], str] = {}
    for r in chosen:
        for p in r.patterns:
            if hazards(p):
                names[r.entity_type, p] = f"__guarded{len(names)}"
    rows = docs.withColumns({column: guarded_spans(F.col(text), p, budget) for (_, p), column in names.items()}) if names else docs

    def entities(r: Recognizer) -> Column:
        def find(t: Column, p: str) -> Column:
            return F.col(names[r.entity_type, p])["spans"] if (r.entity_type, p) in names else find_spans(t, p)

        return r.entities(F.col(text), find)

    failed = F.array_compact(F.array(*(F.when(F.col(column)["failed"], F.lit(kind)) for (kind, _), column in names.items()))) if names else F.array().cast("array<string>")
    rows = rows.withColumn(into, F.concat(no_entities(), *map(entities, chosen))).withColumn(quarantine, F.array_distinct(failed))
    return rows.drop(*names.values())
