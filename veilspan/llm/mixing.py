"""Mixing sources to target weights, in built-in expressions only.

Sizes are words. Every source's documents are dealt by a hash into blocks, and a hash orders the blocks:
a random permutation that reruns repeat. A source whose target is above its size gives each block once in
whole, and what is left of its target is a prefix of the permuted blocks; only in the block where that prefix ends
are single documents chosen. So each source has an exact quota of block draws.

A splitting tree deals the draws to output shards: each node halves its total, and how much of each source's quota
goes left is a draw from the multivariate hypergeometric distribution, source by source. The leaves hold
exact quotas of equal totals; along the permutation each shard takes its quota of every source's blocks, which are disjoint, and
shuffles its documents locally.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents in a block, at least. The number of blocks is held near 2**20, which bounds the tree's work.
BLOCK_ROWS = 256
_MOST_BLOCKS = 1 << 20
#: Words in an output shard, at most, and parts of a shard that are written by different tasks.
SHARD_WORDS = 40_000_000
PARTS = 8


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) that the columns fix."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add weight and target to (source, source_size, ...), a table with a row for each source.

    The reshared targets are least(cap * size, level * weight) at the level where they sum to the share. Sources in
    order of cap * size / weight reach their caps one after the other; the level is that of the first
    source which does not.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share)
    ranked = ranked.withColumn("level", (wanted - before) / after).withColumn("open", F.col("level") <= F.col("most") / F.col("weight"))
    level = F.coalesce(F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return ranked.withColumn("target", F.least("most", level * F.col("weight"))).drop("level", "open", "most")


def _halved(nodes: DataFrame, seed: int) -> DataFrame:
    """Split every node (node, quotas) in two, with totals that differ by one at most."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    state = "struct<all: bigint, left: bigint, taken: array<bigint>>"

    def source(s: Column, x: Column) -> Column:
        # draws one by one: the next goes left with probability left / all of what remains
        def draw(d: Column, i: Column) -> Column:
            goes = (_unit(F.lit(seed), F.col("node"), x["source"], i) * (s["all"] - i + 1) < d["left"]).cast("long")
            return F.struct((d["left"] - goes).alias("left"), (d["taken"] + goes).alias("taken"))

        start = F.struct(s["left"].alias("left"), F.lit(0).cast("long").alias("taken"))
        turns = F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<bigint>"))
        out = F.aggregate(turns, start, draw)
        return F.struct((s["all"] - x["quota"]).alias("all"), out["left"].alias("left"), F.concat(s["taken"], F.array(out["taken"])).alias("taken")).cast(state)

    first = F.struct(F.col("total").alias("all"), F.expr("total div 2").alias("left"), F.array().cast("array<bigint>").alias("taken")).cast(state)
    split = nodes.withColumn("total", total).withColumn("taken", F.aggregate("quotas", first, source, lambda s: s["taken"]))
    left = F.zip_with("quotas", "taken", lambda x, y: F.struct(x["source"].alias("source"), y.alias("quota")))
    right = F.zip_with("quotas", "taken", lambda x, y: F.struct(x["source"].alias("source"), (x["quota"] - y).alias("quota")))
    halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
    return split.select(F.explode(halves).alias("half")).select("half.*")


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, source, lo, hi): the draws lo <= draw < hi of each source that go to each of 2**depth shards.

    ``quotas`` has (source, quota), a row for each source; sources are ids. One row holds a node's quotas.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("quota")))).alias("quotas"))
    tree = tree.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(depth):
        tree = cut(_halved(tree, seed))
    leaves = tree.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.inline("quotas"))
    order = Window.partitionBy("source").orderBy("shard")
    return leaves.withColumn("hi", F.sum("quota").over(order)).select("shard", "source", (F.col("hi") - F.col("quota")).alias("lo"), "hi")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, depth: int | None = None, seed: int = 20240607, block_rows: int = BLOCK_ROWS, columns: list[str] | None = None
) -> DataFrame:
    """The named columns of ``docs`` (all, if none are named) as a struct ``row``, with size, source_size, target, copies, taken and shards.

    Sources in code point order, null last, get ``weights`` in turn and together ``share`` times all words; no
    target is above ``cap`` (a whole number) times its source's size. ``copies`` is how often the mix takes the row, at most ``cap``
    times, ``taken`` the words that makes and ``shards`` the output shard of each copy, of 2**depth; unless given, depth follows
    from the number of words, so that a shard has ``SHARD_WORDS`` at most. The words that a source gives fall short of its target by less than the smallest
    document of its last block that is left. A null text has size 0; a null source is a source; null ids are dealt like any others;
    rows equal in doc_id and text are taken or left together. An empty table gives an empty result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(row.alias("row"), F.xxhash64("source").alias("id"), key.alias("key"))
    # what the plan needs of a row; texts meet the plan in one join at the end
    slim = cut(docs.select("source", size.alias("size"), key.alias("key")))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    each = F.greatest(F.lit(block_rows).cast("long"), F.ceil(total / _MOST_BLOCKS))
    sources = sources.withColumn("blocks", F.ceil(F.col("n") / each)).drop("n")
    sources = _targets(sources, weights, share, cap)
    target, words = F.col("target"), F.col("source_size")
    full = F.when(words > 0, F.floor(target / words)).otherwise(0)
    sources = cut(sources.withColumn("id", F.xxhash64("source")).withColumn("full", full).withColumn("rest", target - F.col("full") * words))

    if depth is None:
        words_out = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
        depth = min(20, max(4, ceil(log2(max(1.0, words_out / SHARD_WORDS)))))
    same = lambda a: a["source"].eqNullSafe(sources["source"])
    block = F.pmod(F.xxhash64("key", F.lit(1)), "blocks")
    of_block = slim.join(sources, same(slim)).select("id", "blocks", block.alias("block"), "size", "full", "rest").groupBy("id", "block").agg(F.sum("size").alias("words"), F.first("full").alias("full"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    order = Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "block"), "block")
    ends = F.sum("words").over(order)
    of_block = of_block.withColumn("turn", F.row_number().over(order) - 1).withColumn("start", ends - F.col("words"))
    # prefix: 2 wholly, 1 where it ends, 0 beyond
    inside = F.when(F.col("start") + F.col("words") <= F.col("rest"), 2).when(F.col("start") < F.col("rest"), 1).otherwise(0)
    of_block = cut(of_block.withColumn("prefix", F.when(F.col("words") == 0, 0).otherwise(inside)))

    quotas = of_block.groupBy("id").agg((F.sum((F.col("prefix") > 0).cast("long")) + F.first("full") * F.count("*")).alias("quota"))
    tree = splitting_tree(quotas.select(F.col("id").alias("source"), "quota"), depth, seed)
    dealt = tree.where("hi > lo").select(F.col("source").alias("id"), "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("draw"))
    # a block's draws: one for each whole pass over its source, then one in the prefix; draws follow the permutation
    passes = F.sequence(F.lit(0).cast("long"), F.col("full") + (F.col("prefix") > 0).cast("long") - 1)
    draws = of_block.where((F.col("full") > 0) | (F.col("prefix") > 0)).select("id", "block", "turn", "full", "blocks", F.explode(passes).alias("pass"))
    nth = Window.partitionBy("id").orderBy("pass", "turn")
    draws = draws.withColumn("draw", F.row_number().over(nth) - 1).join(dealt, ["id", "draw"]).groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    blocks = of_block.join(draws, ["id", "block"], "left").select("id", "block", "start", "prefix", F.transform(F.coalesce("dealt", F.array().cast("array<struct<pass: bigint, shard: int>>")), lambda x: x["shard"]).alias("in_shards"))

    # documents of the blocks where a prefix ends, in their own permuted order
    edge = slim.join(sources, same(slim)).select("id", block.alias("block"), "size", "key", "rest").join(blocks.where("prefix = 1").select("id", "block", "start"), ["id", "block"])
    edge = edge.groupBy("id", "block", "key").agg(F.sum("size").alias("words"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    # in that order each is taken that still fits; a block's keys and sizes are one row
    edge = edge.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("key", "words"))).alias("docs"), F.first(F.col("rest") - F.col("start")).alias("room"))

    def fit(s: Column, x: Column) -> Column:
        fits = x["words"] <= s["room"]
        return F.struct(F.when(fits, s["room"] - x["words"]).otherwise(s["room"]).alias("room"), F.when(fits, F.concat(s["keys"], F.array(x["key"]))).otherwise(s["keys"]).alias("keys"))

    chosen = F.aggregate("docs", F.struct("room", F.array().cast("array<bigint>").alias("keys")), fit, lambda s: s["keys"])
    edge = edge.select("id", "block", F.explode(chosen).alias("key"), F.lit(True).alias("chosen"))

    here = slim.join(sources, same(slim)).select("size", "key", "source_size", "target", "full", "id", block.alias("block"))
    here = here.join(blocks.drop("start"), ["id", "block"]).join(edge, ["id", "block", "key"], "left")
    copies = (F.col("full") + F.when(F.col("prefix") == 2, 1).when(F.col("chosen"), 1).otherwise(0)).cast("int")
    here = here.select("id", "key", "size", "source_size", "target", copies.alias("copies"), "in_shards").dropDuplicates(["id", "key"])
    out = rows.join(here, ["id", "key"])
    return out.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.slice("in_shards", 1, "copies").alias("shards"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row."""
    return mixed(docs, columns=["doc_id"], **parameters).select("row.doc_id", "size", "source_size", "target", "taken", "shards")


def shuffled(docs: DataFrame, seed: int = 20240607, **parameters) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, gathered by shard and shuffled within it.

    A shard is ``PARTS`` runs of its random order, each of which one task sorts. Adds ``shard``, in place of an input column of that name.
    """
    out = mixed(docs, seed=seed, **parameters).select("row", F.posexplode("shards").alias("copy", "shard"))
    out = out.withColumn("order", F.xxhash64(F.lit(seed), "copy", "row")).withColumn("part", F.pmod(F.shiftright("order", 32), F.lit(PARTS)))
    out = out.repartition("shard", "part").sortWithinPartitions("shard", "part", "order")
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"), "shard")
