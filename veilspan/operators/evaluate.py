"""Comparing predicted with labelled entities, combining predictions, and figures about runs.

Tables have a row for each entity with a sample key, entity_type and value. Positions play no part; per sample,
type and value count once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = ("entity_type", "value")


def _distinct(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, *_KEY).distinct()


def matches(predicted: DataFrame, labelled: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, entity_type, value, tp, fp, fn): each distinct entity of either side, told apart by one full outer join."""
    p = _distinct(predicted, key).withColumn("p", F.lit(1))
    g = _distinct(labelled, key).withColumn("g", F.lit(1))
    both = p.join(g, [key, *_KEY], "full_outer")
    hit = lambda c: c.cast("long")
    return both.select(key, *_KEY, hit(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), hit(F.col("g").isNull()).alias("fp"), hit(F.col("p").isNull()).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1, f2 and accuracy to tp, fp and fn; what is undefined is 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp, tp + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": _ratio(2 * p * r, p + r), "f2": _ratio(5 * p * r, 4 * p + r)})


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]


def evaluate(predicted: DataFrame, labelled: DataFrame, key: str = "sample_id") -> DataFrame:
    return metrics(matches(predicted, labelled, key).agg(*_sums()))


def evaluate_by_type(predicted: DataFrame, labelled: DataFrame, key: str = "sample_id") -> DataFrame:
    """Metrics and support of each type, and of all types in the row named ALL, from one aggregation."""
    grouped = matches(predicted, labelled, key).groupingSets([["entity_type"], []], "entity_type").agg(F.grouping("entity_type").alias("all"), *_sums())
    name = F.when(F.col("all") == 1, "ALL").otherwise(F.col("entity_type")).alias("entity_type")
    return metrics(grouped.select(name, "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support")))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of two results of ``evaluate_by_type``; a type that only one has counts as 0 on the other side."""
    cols = ["precision", "recall", "f1"]
    a = old.select("entity_type", *(F.col(c).alias(f"old_{c}") for c in cols))
    b = new.select("entity_type", *(F.col(c).alias(f"new_{c}") for c in cols))
    both = a.join(b, "entity_type", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [zero(F.col(f"{side}_{c}")).alias(f"{side}_{c}") for c in cols for side in ("old", "new")]
    out += [(zero(F.col(f"new_{c}")) - zero(F.col(f"old_{c}"))).alias(f"{c}_change") for c in cols]
    return both.select("entity_type", F.col("old_f1").isNull().alias("is_new"), *out)


def ensemble(*predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """The union of several predictions, as a set."""
    out = _distinct(predictions[0], key)
    for p in predictions[1:]:
        out = out.unionByName(_distinct(p, key))
    return out.distinct()


def missed(predicted: DataFrame, labelled: DataFrame, key: str = "sample_id") -> DataFrame:
    """Labelled entities without a prediction."""
    return _distinct(labelled, key).join(_distinct(predicted, key), [key, *_KEY], "left_anti")


def missed_by_type(predicted: DataFrame, labelled: DataFrame, texts: DataFrame, key: str = "sample_id", examples: int = 3, worst: int | None = None) -> DataFrame:
    """Misses of each type, their rate among all labels, repeats included, and a few examples with the start of their text."""
    lost = missed(predicted, labelled, key)
    order = Window.partitionBy("entity_type").orderBy(key, "value")
    some = lost.withColumn("n", F.row_number().over(order)).where(F.col("n") <= examples).join(texts.select(key, F.left("text", F.lit(100)).alias("text")), key)
    some = some.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("n", "value", "text"))).alias("examples"))
    total = labelled.groupBy("entity_type").agg(F.count("*").alias("total"))
    out = total.join(lost.groupBy("entity_type").agg(F.count("*").alias("missed")), "entity_type", "left").join(some, "entity_type", "left")
    out = out.select("entity_type", "total", F.coalesce("missed", F.lit(0)).alias("missed"), "examples").withColumn("miss_rate", F.col("missed") / F.col("total"))
    return out.orderBy(F.desc("miss_rate"), "entity_type").limit(worst) if worst else out


def accepted(result: DataFrame, f1: float = 0.875, recall: float = 0.90) -> DataFrame:
    return result.withColumn("accepted", (F.col("f1") >= f1) & (F.col("recall") >= recall))


_PARTS = 64


def latency(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """n, min, max, mean, stdev, median, and p50, p95 and p99 as the value at place int(n * p) of the sorted ones.

    Equal values are counted first. Ranges of a group's values, cut at approximate quantiles, are counted next, and only the ranges that hold
    a wanted place are sorted, each by itself, so that no task sorts a whole group.
    """
    keys = [*by] or [F.lit(1).alias("__one")]
    key = [*by] or ["__one"]
    values = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x")).groupBy(*key, "x").agg(F.count("*").alias("c"))
    figures = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x")).groupBy(*key)
    figures = figures.agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stdev"), F.percentile_approx("x", [k / _PARTS for k in range(1, _PARTS)], 1000).alias("__cuts"))
    n = F.col("n")
    places = {"p50": F.floor(n * 0.5), "p95": F.floor(n * 0.95), "p99": F.floor(n * 0.99), "__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)}
    same = lambda a, b: functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key))
    pick = lambda t, *c: [F.col(f"{t}.{k}").alias(k) for k in key] + [F.col(x) for x in c]
    part = F.size(F.filter("__cuts", lambda c: c < F.col("x"))).alias("part")
    parted = values.alias("v").join(figures.select(*key, "__cuts").alias("f"), same("v", "f")).select(*pick("v", "x", "c"), part)
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parted.groupBy(*key, "part").agg(F.sum("c").alias("size")).withColumn("before", before)
    wanted = figures.select(*key, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in places.items()))).alias("w")).select(*key, "w.*")
    wanted = wanted.alias("w").join(sizes.alias("s"), same("w", "s") & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("size"))).select(*pick("w", "name", "part"), (F.col("at") - F.col("before")).alias("at"))
    inner = parted.alias("p").join(wanted.select(*key, "part").distinct().alias("w"), same("p", "w") & (F.col("p.part") == F.col("w.part"))).select(*pick("p", "p.part", "x", "c"))
    ends = inner.withColumn("upto", F.sum("c").over(Window.partitionBy(*key, "part").orderBy("x")))
    found = wanted.alias("w").join(ends.alias("e"), same("w", "e") & (F.col("w.part") == F.col("e.part")) & (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    found = found.select(*pick("w", "name", "x")).groupBy(*key).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in places))
    out = figures.alias("a").join(found.alias("b"), same("a", "b"))
    return out.select(*(F.col(f"a.{k}").alias(k) for k in by), "n", "min", "max", "mean", "stdev", ((F.col("__low") + F.col("__high")) / 2).alias("median"), "p50", "p95", "p99")


def throughput(rows: DataFrame, started: str, ended: str) -> DataFrame:
    """Requests, the seconds from the first start to the last end, and requests per second; times are timestamps or seconds."""
    seconds = lambda c: (F.col(c).cast("timestamp") if rows.schema[c].dataType.typeName() == "timestamp_ntz" else F.col(c)).cast("double")
    out = rows.agg(F.count("*").alias("requests"), (F.max(seconds(ended)) - F.min(seconds(started))).alias("seconds"))
    return out.withColumn("per_second", _ratio(F.col("requests"), F.col("seconds")))


def containment_recall(rows: DataFrame, expected: str, response: str) -> DataFrame:
    """The share of rows whose response contains the expected text."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col(response).contains(F.col(expected)).cast("int")), F.lit(0.0)).alias("recall"))


def progress(lines: DataFrame, line: str = "value", order: str = "line_no", last: int = 500) -> DataFrame:
    """The latest progress line (percent, step, of) among the last lines of a log, and its state: done, error or running."""
    tail = lines.orderBy(F.desc(order)).limit(last)
    part = lambda k: F.regexp_extract(line, r"(\d+)%\|[^|]*\|\s*(\d+)/(\d+)", k)
    at = F.when(F.length(part(1)) > 0, F.struct(F.col(order).alias("at"), part(1).cast("int").alias("percent"), part(2).cast("long").alias("step"), part(3).cast("long").alias("of")))
    done = F.max(F.lower(line).rlike("training completed|训练完成|finished").cast("int"))
    bad = F.max(F.lower(line).rlike(r"\berror\b|traceback|out of memory").cast("int"))
    out = tail.agg(F.max(at).alias("p"), done.alias("done"), bad.alias("bad"))
    state = F.when(F.col("done") == 1, "done").when(F.col("bad") == 1, "error").otherwise("running")
    return out.select("p.percent", "p.step", "p.of", state.alias("state"))


def scraped_metrics(reports: DataFrame, text: str = "value") -> DataFrame:
    """Precision, recall and f1 in percent out of report texts; null where a report has none."""
    find = lambda words: F.regexp_extract(text, rf"(?i)(?:{words})[^0-9\n]*([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    return reports.select("*", find("precision|精确率").alias("precision"), find("recall|召回率").alias("recall"), find("f1").alias("f1"))
