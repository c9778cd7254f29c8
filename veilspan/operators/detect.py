"""The registry of recognizers, detection over tables, and statistics of what was found."""

from __future__ import annotations

import functools
import time
import warnings
from collections.abc import Callable, Iterable, Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.entity import no_entities
from .recognizers import DEFAULTS, HYBRID, Recognizer

MODES = ("fast", "auto", "deep")
MODEL_TYPES = ("PERSON_NAME", "ADDRESS", "ORGANIZATION")


@functools.lru_cache(256)
def _entities_of(recognizer: Recognizer, column: str, context: SparkContext | None) -> Column:
    """A recognizer's expression over a named column; building one takes longer than Catalyst takes to plan it."""
    return recognizer.entities(F.col(column))


class Registry:
    """Recognizers by entity type, in the order of registration. Lives on the driver; plans are built from it."""

    def __init__(self, recognizers: Iterable[Recognizer] = ()):
        self._by_type: dict[str, Recognizer] = {}
        for r in recognizers:
            self.register(r)

    @classmethod
    def default(cls, config: Mapping[str, Mapping] | None = None) -> Registry:
        out = cls()
        out.load_all(config)
        return out

    def register(self, recognizer: Recognizer) -> None:
        if recognizer.entity_type in self._by_type:
            raise ValueError(f"a recognizer of {recognizer.entity_type} is registered already")
        self._by_type[recognizer.entity_type] = recognizer

    def unregister(self, entity_type: str) -> bool:
        return self._by_type.pop(entity_type, None) is not None

    def get(self, entity_type: str) -> Recognizer | None:
        return self._by_type.get(entity_type)

    def recognizers(self) -> list[Recognizer]:
        return list(self._by_type.values())

    def entity_types(self) -> list[str]:
        return list(self._by_type)

    def clear(self) -> None:
        self._by_type.clear()

    def __contains__(self, entity_type: str) -> bool:
        return entity_type in self._by_type

    def __len__(self) -> int:
        return len(self._by_type)

    def load_all(self, config: Mapping[str, Mapping] | None = None) -> int:
        """Register the defaults that are not registered, with fields overridden by type; returns how many are new."""
        new = [r.with_config((config or {}).get(r.entity_type, {})) for r in DEFAULTS if r.entity_type not in self]
        for r in new:
            self.register(r)
        return len(new)

    def metadata(self, entity_type: str) -> dict | None:
        r = self.get(entity_type)
        return r and {"entity_type": r.entity_type, "name": r.name, "patterns": list(r.patterns), "n_patterns": len(r.patterns), "confidence_base": r.base, "context_words": list(r.context_words), "deny_words": list(r.deny_words)}

    def summary(self) -> dict:
        return {"recognizers": len(self), "patterns": sum(len(r.patterns) for r in self.recognizers()), "entity_types": self.entity_types()}

    def chosen(self, entity_types: Iterable[str] | None = None) -> list[Recognizer]:
        """All, or those of the named types in that order; unknown types are ignored."""
        return self.recognizers() if entity_types is None else [self._by_type[t] for t in entity_types if t in self._by_type]

    def entities(self, text: Column | str, entity_types: Iterable[str] | None = None) -> Column:
        """The entities of a column, which is best given by its name: expressions over a name are kept."""
        context = SparkContext._active_spark_context
        found = [_entities_of(r, text, context) if isinstance(text, str) else r.entities(text) for r in self.chosen(entity_types)]
        return F.concat(no_entities(), *found)


def detect(docs: DataFrame, registry: Registry | None = None, text: str = "text", entity_types: Iterable[str] | None = None, into: str = "entities") -> DataFrame:
    """Add the array of detected entities to each row. A narrow projection: one pass, no shuffle."""
    return docs.withColumn(into, (registry or Registry.default()).entities(text, entity_types))


def at_least(entities: Column | str, confidence: float) -> Column:
    """The entities with at least this confidence."""
    return F.filter(entities, lambda e: e["confidence"] >= confidence)


def of_types(entities: Column | str, types: Iterable[str]) -> Column:
    return F.filter(entities, lambda e: e["entity_type"].isin(*types))


def exploded(rows: DataFrame, *keys: str, entities: str = "entities") -> DataFrame:
    """A row for each entity, with its place in the array as ``ord``.

    Rows without entities leave after the explosion: an inner one would make Catalyst test the size of the array below the
    projection that computes it, and so compute it again.
    """
    each = rows.select(*keys, F.posexplode_outer(entities).alias("ord", "entity")).where(F.col("ord").isNotNull())
    return each.select(*keys, "ord", "entity.*")


def hybrid_detect(docs: DataFrame, mode: str = "auto", model: Callable[[DataFrame], DataFrame] | None = None, text: str = "text", entity_types: Iterable[str] | None = None) -> DataFrame:
    """Patterns for the structured types, a model for names, addresses and organisations.

    ``model`` adds ``model_entities`` to a table; without one, deep falls back to auto with a warning, and fast never calls it. Nothing is
    deduplicated here. With ``entity_types`` only those are looked for, in sorted order.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "deep" and model is None:
        warnings.warn("deep mode has no model and falls back to auto", stacklevel=2)
    wanted = None if entity_types is None else sorted(set(entity_types))
    out = detect(docs, Registry(HYBRID), text, wanted)
    if model is None or mode == "fast" or wanted is not None and not set(wanted) & set(MODEL_TYPES):
        return out
    out = model(out)
    found = of_types("model_entities", wanted if wanted is not None else MODEL_TYPES)
    return out.withColumn("entities", F.concat("entities", F.coalesce(found, no_entities()))).drop("model_entities")


def supported_types(model: bool = False) -> dict[str, list[str]]:
    """The types of the hybrid detector by method, and all of them; those of the model only if there is one."""
    patterns, named = [r.entity_type for r in HYBRID], list(MODEL_TYPES) if model else []
    return {"regex": patterns, "llm": named, "all": [*patterns, *named]}


def detector_info(mode: str = "auto", model: bool = False) -> dict:
    """The mode in effect, whether a model is used, and the types by method with their number."""
    types = supported_types(model)
    return {"mode": "auto" if mode == "deep" and not model else mode, "llm_enabled": model, "regex_types": types["regex"], "llm_types": types["llm"], "total_types": len(types["all"])}


class CallStatistics:
    """How many texts each recognizer of a registry has read, and how many hits it had, over the jobs that ran since the last reset.

    The figures are observed in the jobs that detect, without a job of their own; a job that hasn't run is waited for.
    """

    def __init__(self, registry: Registry):
        self.registry = registry
        self.reset()

    def reset(self) -> None:
        self._seen: list[tuple[list[str], Observation]] = []

    def detect(self, docs: DataFrame, text: str = "text", entity_types: Iterable[str] | None = None) -> DataFrame:
        """``detect`` with observation; the result can run once only."""
        types = [r.entity_type for r in self.registry.chosen(entity_types)]
        seen = Observation()
        hits = [F.sum(F.size(of_types("entities", [t])).cast("long")).alias(f"n{k}") for k, t in enumerate(types)]
        self._seen.append((types, seen))
        return detect(docs, self.registry, text, types).observe(seen, F.count(F.lit(1)).alias("calls"), *hits)

    def get(self) -> dict[str, dict[str, int]]:
        out = {t: {"total_calls": 0, "total_hits": 0} for t in self.registry.entity_types()}
        for types, seen in self._seen:
            for k, t in enumerate(types):
                own = out.setdefault(t, {"total_calls": 0, "total_hits": 0})
                own["total_calls"] += seen.get["calls"]
                own["total_hits"] += seen.get[f"n{k}"] or 0
        return out


def profile(docs: DataFrame, registry: Registry | None = None, text: str = "text", entity_types: Iterable[str] | None = None) -> dict[str, dict[str, float]]:
    """What each recognizer costs by itself on a table: calls, hits, seconds of its job beyond those of reading the texts, and the mean of a call.

    A plan runs all recognizers at once and has no time for each, so every one gets a job of its own, one after the other; it is meant for a sample or a test run.
    """
    registry = registry or Registry.default()

    def timed(rows: DataFrame) -> tuple[float, int, int]:
        began = time.perf_counter()
        calls, hits = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("__hits")), F.lit(0))).first()
        return time.perf_counter() - began, calls, hits

    # the length has every text read without a search
    plain = docs.select(F.array_repeat(F.length(text), 1).alias("__hits"))
    timed(plain)  # files and code are warm
    reading, _, _ = timed(plain)
    out = {}
    for r in registry.chosen(entity_types):
        spent, calls, hits = timed(docs.select(r.entities(F.col(text)).alias("__hits")))
        spent = max(0.0, spent - reading)
        out[r.entity_type] = {"total_calls": calls, "total_hits": int(hits), "total_time": spent, "avg_time": spent / calls if calls else 0.0}
    return out


def batch_statistics(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """One row: texts, entities, texts with any, their rate, entities for each text, and counts by type and by method.

    Texts without entities count; both methods are always listed. Rows are counted by type and method as they are read, so that
    one pass over them and a row for each pair are all it takes.
    """
    kept = (F.col("e.entity_type"), F.col("e.detection_method"))
    each = rows.select(F.posexplode_outer(entities).alias("ord", "e")).groupBy(kept[0].alias("type"), kept[1].alias("method"))
    found = F.col("ord").isNotNull()
    # every text has either no entity or one at place 0
    counts = each.agg(F.count_if(found).alias("n"), F.count_if(F.col("ord") == 0).alias("some"), F.count_if(~found).alias("none"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = counts.agg((total("some") + total("none")).alias("total_texts"), total("n").alias("total_entities"), total("some").alias("texts_with_entities"), F.collect_list(F.when(F.col("n") > 0, F.struct("type", "method", "n"))).alias("__each"))

    def by(field: str, names: Column) -> Column:
        sums = lambda k: F.aggregate(F.filter("__each", lambda x: x[field] == k), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return F.map_from_entries(F.transform(F.array_sort(names), lambda k: F.struct(k.alias("key"), sums(k).alias("value"))))

    rate = lambda x: F.when(F.col("total_texts") > 0, x / F.col("total_texts")).otherwise(0.0)
    types = F.array_distinct(F.col("__each.type"))
    methods = F.array_distinct(F.concat(F.array(F.lit("regex"), F.lit("llm")), F.col("__each.method")))
    return one.select("total_texts", "total_entities", "texts_with_entities", rate(F.col("texts_with_entities")).alias("rate"), rate(F.col("total_entities")).alias("mean_entities"), by("type", types).alias("by_type"), by("method", methods).alias("by_method"))


def type_distribution(each: DataFrame, by: str = "entity_type") -> DataFrame:
    """Entities by type with their share of all."""
    from pyspark.sql import Window

    counts = each.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))
