"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and broadcast; every vector is assigned to one leaf by going down to
the nearest centroid. Leaves that get too many rows are split again, level by level, each by a sample of its own rows, so
that their size stays the same however large the table is. A query visits leaves best bin first: a priority queue holds the branches passed by, ordered by their
centroid's distance. How many leaves a query visits is calibrated: for a bounded set of queries the true neighbours among
all rows are found by brute force, and visits widen until the wanted share of them lies in visited leaves.
Visited leaves are a join of (query, leaf) with the leaves' vectors, in blocks; a leaf that holds many
vectors is many blocks, each of which sends on at most k candidates for a query.
"""

from __future__ import annotations

import heapq
from itertools import islice
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that the tree is fitted on, at most, and vectors of the sample in a leaf, at most.
SAMPLE = 20_000
LEAF = 100
BRANCHES = 8
#: Queries for the calibration, at most.
PROBES = 200
#: Vectors in a block of a leaf.
BLOCK_ROWS = 2048
#: Rows in a leaf beyond which it is split, rows of it that the split is fitted on, and children of one split at most.
LEAF_ROWS = 2000
SPLIT_SAMPLE = 1000
SPLIT_INTO = 16
#: Leaves at most, since the tree is broadcast; beyond that leaves grow, and are still searched whole, in blocks.
MOST_LEAVES = 1 << 16


@dataclass
class Tree:
    """Nodes as arrays: ``first`` child or -1, number of children, centroid; leaves are numbered in ``leaf``."""

    centroids: np.ndarray
    first: np.ndarray
    width: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        node = np.zeros(len(x), int)
        while (open_ := np.flatnonzero(self.first[node] >= 0)).size:
            for parent in np.unique(node[open_]):
                own = open_[node[open_] == parent]
                children = self.first[parent] + np.arange(self.width[parent])
                node[own] = children[np.argmax(x[own] @ self.centroids[children].T, axis=1)]
        return self.leaf[node]

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """The leaves in the order of a best-bin-first traversal from a unit vector."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            while self.first[node] >= 0:
                children = self.first[node] + np.arange(self.width[node])
                far = -(self.centroids[children] @ q)
                near = int(np.argmin(far))
                for k, c in enumerate(children.tolist()):
                    if k != near:
                        heapq.heappush(queue, (float(far[k]), c))
                node = int(children[near])
            yield int(self.leaf[node])

    def split(self, children: dict[int, np.ndarray]) -> tuple[Tree, dict[int, list[int]]]:
        """The tree with some leaves replaced by nodes with these children, and the children's numbers; the first child keeps the leaf's."""
        centroids, first, width, leaf = [self.centroids], self.first.copy(), self.width.copy(), self.leaf.copy()
        node_of = {int(x): k for k, x in enumerate(self.leaf) if x >= 0}
        n, leaves, numbers = len(self.first), self.leaves, {}
        for number, own in children.items():
            node = node_of[number]
            first[node], width[node], leaf[node] = n, len(own), -1
            centroids.append(own)
            numbers[number] = [number, *range(leaves, leaves + len(own) - 1)]
            n, leaves = n + len(own), leaves + len(own) - 1
        flat = np.array([x for own in numbers.values() for x in own], int)
        none = np.full(len(flat), -1)
        return Tree(np.concatenate(centroids), np.append(first, none), np.append(width, none + 1), np.append(leaf, flat)), numbers


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centers)
    return centers, np.argmax(x @ centers.T, axis=1)


def grow(x: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 5) -> Tree:
    """Split unit vectors by spherical k-means until each leaf has at most ``leaf`` of them or equal ones only."""
    rng = np.random.default_rng(seed)
    centroids, first, width, number = [x.mean(axis=0) if len(x) else np.zeros(1)], [-1], [0], [-1]
    todo = [(0, np.arange(len(x)))]
    leaves = 0
    while todo:
        node, own = todo.pop()
        label = None
        if len(own) > leaf:
            centers, label = _kmeans(x[own], min(branches, len(own)), rng)
            used = np.unique(label)
        if label is None or len(used) < 2:
            number[node], leaves = leaves, leaves + 1
            continue
        first[node], width[node] = len(first), len(used)
        for k in used:
            todo.append((len(first), own[label == k]))
            centroids.append(centers[k])
            first.append(-1)
            width.append(0)
            number.append(-1)
    return Tree(np.array(centroids), np.array(first), np.array(width), np.array(number))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component near 1: no cosine changes by a bit, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _scaled(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with a vector; equal rows get equal values wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the rows that may take part: a known id, no null or non-finite component, not zero; v is an array of doubles.

    ``row`` tells rows apart that share an id; the table is checkpointed so that it stays.
    """
    v = F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return cut(out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows with the commonest length of vectors, of equally common ones the least: others have no cosine with them."""
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n")
    return rows.where(F.size("v") == most.n) if (most := lengths.first()) else rows


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def brute_force(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(query, vec_id, score, v): exact neighbours of a stated, bounded set of query rows against all rows, in blocks."""
    numbers, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, BLOCK_ROWS) for x in batches for i in range(0, x.num_rows, BLOCK_ROWS)):
            own, ids, x = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            for query, vector in zip(numbers, q, strict=True):
                others = np.flatnonzero(own != query)
                best = others[_best(ids[others], cosines(x[others], vector), k)]
                yield pa.record_batch([pa.array(np.full(len(best), query)), pa.array(ids[best]), pa.array(cosines(x[best], vector)), batch.column("v").take(pa.array(best))], names=["query", "vec_id", "score", "v"])

    return ranked(rows.mapInArrow(run, "query long, vec_id long, score double, v array<double>"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _taken(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` rows by a hash of the id, on the driver."""
    picked = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id", "row").limit(most).collect()
    x = np.array([r.v for r in picked], np.float64)
    return np.array([r.row for r in picked], np.int64), _scaled(x) if len(picked) else x


def calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that, for the probes, this share of the true neighbours lies in visited leaves."""
    numbers, q = _taken(queries, PROBES)
    if not len(numbers):
        return 1
    units = dict(zip(numbers.tolist(), _unit(q), strict=True))
    truth = brute_force(rows, (numbers, q), k).select("query", "v").collect()  # at most PROBES * k rows
    if not truth:
        return tree.leaves
    leaves = tree.assign(_unit(_scaled(np.array([r.v for r in truth], np.float64)))).tolist()
    visits = []
    for query, unit in units.items():
        wanted = [leaf for r, leaf in zip(truth, leaves, strict=True) if r.query == query]
        place, left = {}, set(wanted)
        for n, leaf in enumerate(tree.best_bins(unit), 1):
            if not left:
                break
            if leaf in left:
                place[leaf] = n
                left.remove(leaf)
        visits += map(place.__getitem__, wanted)
    return sorted(visits)[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)]


def _indexed(rows: DataFrame, tree: Tree) -> DataFrame:
    """The rows with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.assign(_unit(_matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], names=[*batch.schema.names, "leaf"])

    return cut(rows.mapInArrow(run, "row long, vec_id long, v array<double>, leaf int"))


def _moved(rows: DataFrame, children: dict[int, np.ndarray], numbers: dict[int, list[int]]) -> DataFrame:
    """Rows of leaves that are split, with the number of the child that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, x = batch.column("leaf").to_numpy(), _unit(_matrix(batch.column("v")))
            new = old.copy()
            for leaf in np.unique(old).tolist():
                own = np.flatnonzero(old == leaf)
                new[own] = np.array(numbers[leaf])[np.argmax(x[own] @ children[leaf].T, axis=1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v")), pa.array(new, pa.int32())], names=["row", "vec_id", "v", "leaf"])

    return cut(rows.mapInArrow(run, "row long, vec_id long, v array<double>, leaf int"))


def refined(rows: DataFrame, tree: Tree, leaf_rows: int = LEAF_ROWS, most_leaves: int = MOST_LEAVES) -> tuple[Tree, DataFrame]:
    """The tree with leaves of at most ``leaf_rows`` rows, as far as the rows differ and ``most_leaves`` allows, and the rows with their leaf.

    Each level moves the rows of the leaves that it splits and leaves the others alone. The driver gets the sizes of leaves and the new centroids.
    """
    open_, settled, done = _indexed(rows, tree), [], set()
    while True:
        large = open_.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).collect()
        large = sorted((r.n, r.leaf) for r in large if r.leaf not in done)[::-1]
        large = large[: max(0, (most_leaves - tree.leaves) // (SPLIT_INTO - 1))]
        if not large:
            break
        into = {leaf: min(SPLIT_INTO, -(-2 * n // leaf_rows)) for n, leaf in large}
        named = lambda leaves: F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in leaves], "leaf int"))  # noqa: E731  at most most_leaves rows
        place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64(F.lit(4), "vec_id"), "row"))
        chosen = open_.join(named(into), "leaf", "left_semi").withColumn("place", place).where(F.col("place") <= SPLIT_SAMPLE).select("leaf", "v")

        def split(own: pa.Table) -> pa.Table:
            leaf, x = own.column("leaf")[0].as_py(), _unit(_matrix(own.column("v").combine_chunks()))
            centers, label = _kmeans(x, min(into[leaf], len(x)), np.random.default_rng(leaf))
            used = centers[np.unique(label)]
            return pa.table({"leaf": pa.array([leaf] * len(used), pa.int32()), "v": pa.array(list(used), pa.list_(pa.float64()))})

        children: dict[int, list] = {leaf: [] for leaf in into}
        for r in chosen.groupBy("leaf").applyInArrow(split, "leaf int, v array<double>").collect():
            children[r.leaf].append(r.v)
        done |= {leaf for leaf, own in children.items() if len(own) < 2}  # equal vectors only
        new = {leaf: np.array(sorted(own)) for leaf, own in children.items() if len(own) > 1}
        if not new:
            continue
        tree, numbers = tree.split(new)
        settled.append(open_.join(named(new), "leaf", "left_anti"))
        open_ = _moved(open_.join(named(new), "leaf", "left_semi"), new, numbers)
    for part in settled:
        open_ = open_.unionByName(part)
    return tree, open_


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, sample: int = SAMPLE, leaf: int = LEAF, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, by cosine of the original vectors.

    ``vectors`` has vec_id and embedding; other columns are not read, but ``is_query`` may use vec_id only. A query row is no candidate of its own; rows that
    share an id are queries and candidates of their own. Rows with a null id or a null, zero or non-finite vector take no part, nor do
    rows whose vector has another length than most. Fewer candidates than k are all returned. An empty table gives an empty result.
    """
    rows = of_one_length(usable(vectors))
    queries = rows.where(is_query)
    _, x = _taken(rows, sample)
    out = "query long, query_id long, vec_id long, score double"
    if not len(x):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, indexed = refined(rows, grow(_unit(x), leaf), leaf_rows)
    visits = calibrated(rows, queries, tree, k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [list(islice(tree.best_bins(u), visits)) for u in _unit(_matrix(batch.column("q")))]
            at = np.repeat(np.arange(len(bins)), [len(x) for x in bins])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array([x for y in bins for x in y], pa.int32())], names=["query", "query_id", "q", "leaf"])

    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = indexed.join(F.broadcast(sizes), "leaf")  # a row for each leaf, at most MOST_LEAVES
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks")
    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(route, "query long, query_id long, q array<double>, leaf int")
    asked = asked.join(F.broadcast(sizes), "leaf").select("query", "query_id", "q", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def score(own: pa.Table, ask: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        if len(own) and len(ask):
            numbers, ids, x = own.column("row").to_numpy(), own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks())
            asks = zip(ask.column("query").to_pylist(), ask.column("query_id").to_pylist(), _matrix(ask.column("q").combine_chunks()), strict=True)
            for query, name, vector in asks:
                others = np.flatnonzero(numbers != query)
                scores = cosines(x[others], vector)
                best = _best(ids[others], scores, k)
                found.append((np.full(len(best), query), np.full(len(best), name), ids[others][best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query", "query_id", "vec_id", "score"), columns, kinds, strict=True)})

    found = blocks.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInArrow(score, out)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
