"""Spans that overlap, on a row for each span: joins of two tables of them, and the overlap merge as a sweep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .refine import OVERLAP

#: Positions in a cell by which a key's spans are cut into segments that don't touch.
CELL = 4096


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def _mean_length(rows: DataFrame, start: str, end: str) -> float:
    return rows.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1.0


def interval_join(left: DataFrame, right: DataFrame, key: str, start: str = "start_pos", end: str = "end_pos", width: int | None = None) -> DataFrame:
    """Pairs of rows of two tables with one key whose spans share a position; columns of the right table that the left one has, get the suffix ``_other``.

    Spans are dealt into bins of ``width`` positions, by default four times their mean length, and meet in those that both cover; a pair is given in the bin where the later one begins, and so once.
    A key with many spans is as many groups as it has bins. Rows without a key, or whose span is null or empty, meet nothing.
    """
    if width is None:
        width = max(1, round(4 * max(_mean_length(left, start, end), _mean_length(right, start, end))))

    def binned(rows: DataFrame, rename: Callable[[str], str]) -> DataFrame:
        sound = rows.where(F.col(key).isNotNull() & (F.col(end) > F.col(start)))
        named = sound.select(*(F.col(f"`{c}`").alias(rename(c)) for c in rows.columns))
        return named.withColumn("__bin", F.explode(_bins(F.col(rename(start)), F.col(rename(end)), width)))

    other = {c: f"{c}_other" if c in left.columns else c for c in right.columns}
    a, b = binned(left, lambda c: c), binned(right, lambda c: other[c]).withColumnRenamed("__bin", "__bin_other")
    on = (F.col(key) == F.col(other[key])) & (F.col("__bin") == F.col("__bin_other"))
    shared = (F.col(start) < F.col(other[end])) & (F.col(other[start]) < F.col(end))
    first = F.floor(F.greatest(start, other[start]) / width) == F.col("__bin")
    return a.join(b, on & shared & first).drop("__bin", "__bin_other", other[key])


def with_segments(each: DataFrame, key: str, cell: int = CELL, into: str = "__segment") -> DataFrame:
    """Add the number of a segment of its key's positions to each span; spans of different segments never overlap.

    A segment ends at the first edge of a cell that no span crosses, so a key with many spans is many segments. The windows read a row for each cell.
    """
    at = F.floor(F.col("start_pos") / cell)
    cells = each.groupBy(F.col(key).alias("__key"), at.alias("__cell")).agg(F.max("end_pos").alias("__end"))
    before = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    clean = F.coalesce(F.max("__end").over(before) <= F.col("__cell") * cell, F.lit(True)).cast("long")
    cells = cells.withColumn("__clean", clean)
    cells = cells.withColumn(into, F.sum("__clean").over(Window.partitionBy("__key").orderBy("__cell"))).select("__key", "__cell", into)
    spans = each.withColumn("__cell", at)
    return spans.join(cells, spans[key].eqNullSafe(cells["__key"]) & (spans["__cell"] == cells["__cell"])).select(*(spans[f"`{c}`"] for c in each.columns), into)


class _Group:
    """A head and what it has absorbed."""

    def __init__(self, e: dict):
        self.head, self.longest, self.surest, self.mixed = e, e, e, False

    def fits(self, e: dict, least: float) -> bool:
        shared = min(self.head["end_pos"], e["end_pos"]) - max(self.head["start_pos"], e["start_pos"])
        return shared > 0 and shared >= least * min(self.head["end_pos"] - self.head["start_pos"], e["end_pos"] - e["start_pos"])

    def absorb(self, e: dict) -> None:
        more = len(e["value"]) - len(self.longest["value"])
        if more > 0 or not more and e["confidence"] > self.longest["confidence"]:
            self.longest = e
        if e["confidence"] > self.surest["confidence"]:
            self.surest = e
        self.mixed |= e["entity_type"] != self.head["entity_type"]

    def best(self) -> dict:
        return self.surest if self.mixed else self.longest


def _swept(schema: pa.Schema, least: float) -> Callable:
    """Sorted spans to what stays of each group; only groups whose head may still overlap a span are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                of = e.pop("__key"), e.pop("__segment")
                if of != now:
                    out += [g.best() for g in open_]
                    now, open_ = of, []
                out += [g.best() for g in open_ if g.head["end_pos"] <= e["start_pos"]]
                open_ = [g for g in open_ if g.head["end_pos"] > e["start_pos"]]
                group = next((g for g in open_ if g.fits(e, least)), None)
                if group:
                    group.absorb(e)
                else:
                    open_.append(_Group(e))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist([g.best() for g in open_], schema=schema)

    return run


def merge_overlapping_rows(each: DataFrame, key: str, order: str = "ord", least: float = OVERLAP, cell: int = CELL) -> DataFrame:
    """``merge_overlapping`` on a row for each entity: a sweep over sorted segments, with the rows that stay.

    Tasks get whole segments, see ``with_segments``, and hold the groups that are open at one position. ``order`` breaks ties as places in an array do.
    """
    rows = with_segments(each, key, cell).withColumn("__key", F.col(key).cast("string"))
    rows = rows.withColumn("__length", F.length("value")).repartition(key, "__segment")
    rows = rows.sortWithinPartitions(key, "__segment", "start_pos", F.desc("__length"), order).drop("__length")
    return rows.mapInArrow(_swept(to_arrow_schema(each.schema), least), each.schema)
