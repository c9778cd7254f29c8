"""Exact top-k by inner product with vector-approximation files.

Components are whole numbers. A grid cuts each dimension into cells, with edges that a bounded sample suggests and outermost edges
that all rows set; the approximation of a vector is its cell in each dimension, a byte each. Scanning the approximations bounds a query's
score with every vector from below and above: what cannot be among the best by these bounds goes. Exact vectors are then read in the order of
their bounds, in rounds, until no unread one can reach the k-th exact score.

Equal vectors are one class with its first members, so that no number of copies makes a query's list long. Queries meet
the approximations in blocks of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
#: Cells in a dimension, and vectors that their edges are taken from, at most.
CELLS = 64
SAMPLE = 10_000
#: Approximations and queries that meet in a task.
PART_ROWS = 16_384
QUERY_ROWS = 2048
#: Numbers in a block of approximations that is bounded at once, and queries it is bounded for.
_BLOCK_NUMBERS = 1 << 18
_BLOCK_QUERIES = 256
#: Parts of a class of equal vectors that are thinned to their first members before they meet.
_CLASS_PARTS = 64
#: Exact vectors read for a query in the first round, times k; each further round reads four times as many.
_FIRST_READ = 4
_LONG = (-(1 << 63), (1 << 63) - 1)


def _lists(x: np.ndarray, lengths: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(x, kind))


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-number components floor(256 x), exact as doubles, and a digest that equal vectors share."""
    for batch in batches:
        v = batch.column("v")
        with np.errstate(over="ignore"):
            c = np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE) + 0.0  # no negative zero
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        keys = [hashlib.blake2b(c[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([batch.column("row"), batch.column("vec_id"), pa.array(keys, pa.binary()), _lists(c, lengths)], names=["row", "vec_id", "key", "c"])


def _rows(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, key, c) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return cut(out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(_scaled, "row long, vec_id long, key binary, c array<double>"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(cls, key, id, members, c): equal vectors with their least id and their k + 1 first rows."""
    place = Window.partitionBy("key", F.pmod("row", F.lit(_CLASS_PARTS))).orderBy("vec_id", "row")
    few = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    member = F.struct("vec_id", "row")
    out = few.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(member)), 1, k + 1).alias("members"), F.min_by("c", member).alias("c"))
    return cut(out.select(F.monotonically_increasing_id().alias("cls"), "key", F.col("members")[0]["vec_id"].alias("id"), "members", "c"))


def _padded(column: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of length d; a shorter one ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def _ranges(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            x = _padded(batch.column("c"), d)
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if low.size and low[0] <= high[0]:
            yield pa.record_batch([pa.array(np.arange(d)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    return run


class Grid:
    """The cells of each dimension: ``low`` and ``high`` have the least and the largest whole number of each, one row a dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray, cells: int = CELLS):
        d = len(low)
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest").T if len(sample) else np.repeat(low[:, None], cells - 1, axis=1)
        self.edges = np.clip(inner, low[:, None], high[:, None])
        self.low = np.concatenate([low[:, None], self.edges], axis=1)
        self.high = np.concatenate([np.maximum(self.edges - 1, low[:, None]), high[:, None]], axis=1)
        with np.errstate(over="ignore"):
            largest = np.maximum(np.abs(low), np.abs(high)).max(initial=0)
            #: Whether doubles hold every score and bound exactly; else bounds are widened and scores take whole numbers of any length.
            self.exact = bool(d * largest * largest < 1 << 53)

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):
            out[:, j] = np.searchsorted(self.edges[j], x[:, j], "right")
        return out

    def bounds(self, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each query (rows) can have with each approximation (columns)."""
        at = np.arange(cells.shape[1])
        low, high, up, down = self.low[at, cells], self.high[at, cells], np.maximum(q, 0), np.minimum(q, 0)
        if self.exact:
            return up @ low.T + down @ high.T, up @ high.T + down @ low.T
        with np.errstate(over="ignore", invalid="ignore"):
            slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * (2.0 ** -50 * (q.shape[1] + 2))
            least, most = up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack
        limit = 2.0**63  # as scores are
        return np.clip(np.nan_to_num(least, nan=-limit), -limit, limit), np.clip(np.nan_to_num(most, nan=limit), -limit, limit)


def possible(least: np.ndarray, most: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which candidates can be among the k best by score, ties to the smaller id: k others that are certain to stand before a candidate exclude it."""
    if len(least) <= k:
        return np.arange(len(least))
    bar = np.partition(least, len(least) - k)[len(least) - k]
    at = np.flatnonzero(least >= bar)
    last = at[np.lexsort((ids[at], -least[at]))[k - 1]]
    return np.flatnonzero((most > bar) | ((most == bar) & (ids <= ids[last])))


_FOUND = "query long, cls long, id long, least double, most double"


def _bounded(grid: Grid, d: int, k: int) -> Callable:
    def run(files: pa.Table, asks: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = [(none, none, none, np.zeros(0), np.zeros(0))]
        if len(files) and len(asks):
            ids, classes = files.column("id").to_numpy(), files.column("cls").to_numpy()
            cells = np.frombuffer(b"".join(files.column("cells").to_pylist()), np.uint8).reshape(len(ids), d)
            queries, x = asks.column("query").to_numpy(), _padded(asks.column("q"), d)
            step = max(16, _BLOCK_NUMBERS // max(d, 1))
            for first in range(0, len(queries), _BLOCK_QUERIES):
                held = {}
                for a in range(0, len(ids), step):
                    own, block = ids[a : a + step], np.arange(a, min(a + step, len(ids)))
                    least, most = grid.bounds(cells[a : a + step], x[first : first + _BLOCK_QUERIES])
                    for i in range(len(least)):
                        kept = (block, own, least[i], most[i])
                        if i in held:
                            bar = held[i][4]
                            new = np.flatnonzero(most[i] >= bar)
                            kept = tuple(np.concatenate([p, q[new]]) for p, q in zip(held[i][:4], kept, strict=True))
                            if not len(new):
                                continue
                        at = possible(kept[2], kept[3], kept[1], k)
                        kept = tuple(p[at] for p in kept)
                        bar = np.partition(kept[2], len(at) - k)[len(at) - k] if len(at) >= k else -np.inf
                        held[i] = (*kept, bar)
                for i, (at, own, least, most, _) in held.items():
                    found.append((np.full(len(at), queries[first + i]), classes[at], own, least, most))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("query", "cls", "id", "least", "most"), map(pa.array, columns), strict=True)))

    return run


def _products(d: int, exact: bool) -> Callable:
    """Inner products of the rows' two vectors, in whole numbers; those beyond a long count as the largest or the least one."""

    def whole(x: float) -> int:
        return int(x) if abs(x) < float("inf") else (1 if x > 0 else -1) << 1032

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = _padded(batch.column("c"), d), _padded(batch.column("q"), d)
            if exact:
                score = (x * q).sum(axis=1).astype(np.int64)
            else:
                exactly = (sum(whole(a) * whole(b) for a, b in zip(*r, strict=True)) for r in zip(x.tolist(), q.tolist(), strict=True))
                score = np.array([min(max(s, _LONG[0]), _LONG[1]) for s in exactly], np.int64)
            yield pa.record_batch([batch.column("query"), batch.column("cls"), batch.column("id"), pa.array(score)], names=["query", "cls", "id", "score"])

    return run


def _first(rows: DataFrame, k: int, by: str, value: str) -> DataFrame:
    """The k first rows of each query by a number, the highest first, then ``value``."""
    place = Window.partitionBy("query").orderBy(F.col(by).desc(), value)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _still(found: DataFrame, best: DataFrame, k: int, by: str) -> DataFrame:
    """The candidates that can still pass the k-th of ``best``; all of a query that has fewer."""
    bar = best.where(F.col("place") == k).select("query", F.col(by).cast("double").alias("bar"), F.col("id").alias("bar_id"))
    passes = F.col("bar").isNull() | (F.col("most") > F.col("bar")) | ((F.col("most") == F.col("bar")) & (F.col("id") <= F.col("bar_id")))
    return found.join(bar, "query", "left").where(passes).drop("bar", "bar_id")


def search_exact(vectors: DataFrame, is_query: Column, k: int = 5, cells: int = CELLS, sample: int = SAMPLE, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product with each query row, ties to the smaller vec_id.

    Components are taken as floor(256 x). ``vectors`` has vec_id and embedding; other columns are not read, but ``is_query`` may use vec_id only. A
    query row is no candidate of its own; rows that share an id, or a vector, are queries and candidates of their own. Rows with a null id or a null vector, or a null or
    non-finite component, take no part; a zero vector does, and a vector shorter than others counts as ending in zeros. Fewer candidates
    than k are all returned. A score beyond a long is given as, and ranked with, the largest or the least long. An empty table gives an empty result.
    """
    spark, top = vectors.sparkSession, k + 1
    rows = _rows(vectors)
    classes = _classes(rows, k)
    d, n = classes.agg(F.max(F.size("c")), F.count("*")).first()
    asked = rows.where(is_query).select("row", "vec_id", "key")
    queries = classes.join(asked.select("key").distinct(), "key").select(F.col("cls").alias("query"), F.col("c").alias("q"))
    queries = cut(queries)
    m = queries.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranges = classes.select("c").mapInArrow(_ranges(d), "dim long, low double, high double").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    picked = classes.orderBy(F.xxhash64(F.lit(5), "id"), "id", "cls").limit(max(1, min(sample, (1 << 22) // max(d, 1)))).select("c")
    grid = Grid(np.array([r.low for r in ranges]), np.array([r.high for r in ranges]), _padded(pa.array([r.c for r in picked.collect()], pa.list_(pa.float64())), d), cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.tobytes() for x in grid.cells(_padded(batch.column("c"), d))]
            yield pa.record_batch([batch.column("cls"), batch.column("id"), pa.array(own, pa.binary())], names=["cls", "id", "cells"])

    blocks = lambda rows, each: max(1, -(-rows // each))
    parts, asks = blocks(n, part_rows), blocks(m, query_rows)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")  # noqa: E731  both sides of a cogroup need one type
    files = classes.select("cls", "id", "c").mapInArrow(approximate, "cls long, id long, cells binary").select("*", dealt("cls", parts).alias("part"), every(asks).alias("ask"))
    ask = queries.select("*", dealt("query", asks).alias("ask"), every(parts).alias("part"))
    found = cut(files.groupBy("part", "ask").cogroup(ask.groupBy("part", "ask")).applyInArrow(_bounded(grid, d, top), _FOUND))
    left = _still(found, _first(found, top, "least", "id"), top, "least")
    turn = Window.partitionBy("query").orderBy(F.col("most").desc(), "id", "cls")
    left = cut(left.withColumn("turn", F.row_number().over(turn)))
    best, read = None, _FIRST_READ * top
    vector = classes.select("cls", "c")
    while not left.isEmpty():
        now = left.where(F.col("turn") <= read).select("query", "cls", "id")
        scored = now.join(vector, "cls").join(queries, "query").select("query", "cls", "id", "c", "q").mapInArrow(_products(d, grid.exact), "query long, cls long, id long, score long")
        best = cut(_first(scored if best is None else best.drop("place").unionByName(scored), top, "score", "id"))
        left = left.where(F.col("turn") > read)
        left = cut(_still(left, best, top, "score") if grid.exact else left)
        read *= 4
    members = best.join(classes.select("cls", "members"), "cls").select("query", "score", F.explode("members").alias("member")).select("query", "score", "member.*")
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    members = members.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    lists = members.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("best"))
    named = lists.join(classes.select(F.col("cls").alias("query"), "key"), "query").select("key", "best")
    out = asked.join(named, "key").select(F.col("vec_id").alias("query_id"), F.posexplode(F.expr(f"slice(filter(best, x -> x.row != row), 1, {k})")).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
