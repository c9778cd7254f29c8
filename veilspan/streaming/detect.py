"""Detection, refinement and rewriting on streams. They are projections of a row, so the batch transforms run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.anonymize import Anonymizer
from ..operators.detect import Registry, detect
from ..operators.refine import refine


def anonymized_stream(docs: DataFrame, anonymizer: Anonymizer, registry: Registry | None = None, text: str = "text") -> DataFrame:
    """Detect, refine and rewrite each row of a stream (or of a table), in append mode."""
    return anonymizer.apply(refine(detect(docs, registry, text), text=text), text)


def counts_by_window(docs: DataFrame, time: str, width: str, late: str, registry: Registry | None = None, text: str = "text") -> DataFrame:
    """Entities by type in tumbling windows of event time; rows later than ``late`` behind the newest are dropped with their window."""
    found = detect(docs.withWatermark(time, late), registry, text).select(time, F.explode_outer("entities").alias("e")).where("e is not null")
    return found.groupBy(F.window(time, width), "e.entity_type").agg(F.count("*").alias("n"))
