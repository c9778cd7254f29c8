"""Interval joins, segments and the overlap sweep against plain loops and the array form."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions.entity import ENTITIES
from veilspan.operators.detect import exploded
from veilspan.operators.intervals import interval_join, merge_overlapping_rows, with_segments
from veilspan.operators.refine import merge_overlapping

SPANS = "k long, start_pos int, end_pos int, name string"


def random_spans(seed, n, keys=4, reach=300, longest=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(reach)
        b = a + rng.choice([0, 1, 2, 5, longest, reach]) if rng.random() < 0.9 else None
        out.append((rng.randrange(keys) if rng.random() < 0.95 else None, a, b, f"{seed}-{i}"))
    return out


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_interval_join(spark, width):
    left, right = random_spans(1, 120), random_spans(2, 120)
    got = interval_join(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), "k", width=width)
    assert got.columns == ["k", "start_pos", "end_pos", "name", "start_pos_other", "end_pos_other", "name_other"]
    sound = lambda rows: [r for r in rows if r[0] is not None and r[2] is not None and r[2] > r[1]]
    wanted = sorted((a[3], b[3]) for a in sound(left) for b in sound(right) if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r.name, r.name_other) for r in got.collect()) == wanted
    assert interval_join(spark.createDataFrame([], SPANS), spark.createDataFrame(right, SPANS), "k").collect() == []


def entities(seed, n, reach):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(reach)
        size = rng.choice([1, 2, 3, 8, 20])
        out.append((rng.choice("ABC"), "v" * rng.choice([size, size, 2]), a, a + size, rng.choice([0.5, 0.8, 0.9]), "regex", "r", {"n": str(a)}))
    return out


@pytest.mark.parametrize("cell", [1, 16, 4096])
def test_the_sweep_is_the_fold(spark, cell):
    docs = spark.createDataFrame([(k, entities(k, 60, 10 + 40 * k)) for k in range(6)] + [(9, []), (None, entities(3, 20, 30))], f"doc_id long, entities {ENTITIES}")
    wanted = exploded(docs.withColumn("entities", merge_overlapping(F.col("entities"))), "doc_id").drop("ord")
    each = exploded(docs, "doc_id")
    got = merge_overlapping_rows(each, "doc_id", cell=cell)
    assert got.columns == each.columns
    rows = lambda df: sorted((repr(r) for r in df.collect()))
    assert rows(got.drop("ord")) == rows(wanted)


def test_a_document_of_many_spans_is_many_segments(spark):
    """A hundred thousand spans of one document, by many tasks."""
    n = 100_000
    each = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("entity_type"), F.lit("12345678").alias("value"),
        (F.col("id") * 10 - F.col("id") % 2 * 5).cast("int").alias("start_pos"), (F.col("id") * 10 - F.col("id") % 2 * 5 + 8).cast("int").alias("end_pos"), F.lit(0.5).alias("confidence"),
    )
    segments = with_segments(each, "doc_id").groupBy("__segment").count().collect()
    assert len(segments) > 90 and max(r["count"] for r in segments) < 2000 and sum(r["count"] for r in segments) == n
    kept = merge_overlapping_rows(each, "doc_id")
    assert kept.select(F.countDistinct("start_pos"), F.count("*")).first() == (n // 2, n // 2)  # each odd one overlaps the even one before it by three of eight
