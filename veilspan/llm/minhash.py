"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has ``coordinates`` bins. In each round every shingle is hashed into one bin with a value; a bin
keeps the least value of the first round that reached it. After as many rounds as there are bins, round
by round one bin takes the least value over all shingles, so every bin fills whatever the size of the set; large sets
need one or two rounds. Two sets agree in a bin with probability equal to their similarity, and since
shingles of one round are placed without replacement the number of equal bins is concentrated.

Rows with equal shingle sets are one class, so exact copies cost one row. Classes that agree in a whole band
of bins meet in a bucket. Classes that cannot reach the threshold with anyone, because too many of their shingles occur nowhere
else, leave first. Inside a bucket no pairs are listed: one hub, the class that meets most others, is verified against the members,
and buckets whose members are in one component are done. What is left of the others meets by prefix filtering: classes
of different components are compared only if they share one of their rarest shingles and no bound on their sizes forbids a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, block_of, chunks, cut, give_back, mix, packed_blocks, signed, unpacked

#: Common shingles whose order the driver hands to the tasks, at most. It bears on speed only: any order of shingles finds all pairs.
HEAVY = 1 << 16
_ROUNDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lowered(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes; A-Z are lowered first."""
    w = Words(_lowered(buf), offsets)
    lane, sums = w.sequence(0)
    last = np.minimum(np.arange(len(w)) + size, w.first[1:][w.doc])
    hashes = lane.ranges(sums, np.arange(len(w)), last)
    for first, n in zip(w.first, w.counts, strict=False):
        yield np.unique(hashes[first : first + max(n - size + 1, min(n, 1))])


def sketch(items: np.ndarray, coordinates: int) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes; ``coordinates`` is a power of two."""
    out, empty = np.zeros(coordinates, np.uint64), np.ones(coordinates, bool)
    top = np.iinfo(np.uint64).max
    for k in range(2 * coordinates):
        h = mix(items ^ _ROUNDS[k])
        if k < coordinates:
            least = np.full(coordinates, top)
            np.minimum.at(least, (h & np.uint64(coordinates - 1)).astype(np.intp), h >> np.uint64(8))
            new = empty & (least != top)
        else:
            new, least = empty & (np.arange(coordinates) == k - coordinates), h.min() >> np.uint64(8)
        out[new] = mix((least if k >= coordinates else least[new]) + _ROUNDS[k])
        empty &= ~new
        if not empty.any():
            break
    return out


def _bands(sketches: np.ndarray, bands: int) -> np.ndarray:
    parts = sketches.reshape(len(sketches), bands, -1)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_ROUNDS[:bands], parts.shape[:2]).copy()
        for k in range(parts.shape[2]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _sketched(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.schema.names[2:]
            for a, b, buf, offsets in chunks(batch.column("text")):
                n, sums, found, full = [], [], [], []
                for k, items in enumerate(shingle_sets(buf, offsets, size)):
                    n.append(len(items))
                    sums.append(_class_key(items))
                    if len(items):
                        full.append(k)
                        found.append(sketch(items, bands * rows))
                keys = _bands(np.array(found), bands) if found else np.zeros((0, bands), np.uint64)
                lengths = np.zeros(b - a + 1, np.int32)
                lengths[np.array(full, int) + 1] = bands
                sums = np.array(sums, np.int64).reshape(-1, 2)
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(signed(keys.reshape(-1)))), *(batch.column(x)[a:b] for x in more)], names=["doc_id", "n_shingles", "s1", "s2", "bands", *more])
        give_back()

    return run


def _class_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    s1, s2 = signed(np.array([mix(items ^ r).sum(dtype=np.uint64) for r in _ROUNDS[-2:]], np.uint64)).tolist()
    return s1, s2


def _sets(size: int):
    """The shingles of the documents asked for in a block."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        wanted: dict[int, dict[tuple[int, int], int]] = {}
        for doc, node, *key in zip(*(asked.column(c).to_pylist() for c in ("doc", "node", "s1", "s2")), strict=True):
            wanted.setdefault(doc, {})[tuple(key)] = node
        nodes, sets = [], [np.zeros(0, np.uint64)]
        for batch in unpacked(texts.column("piece")) if wanted else ():
            ids = batch.column("doc_id").to_pylist()
            rows = [k for k, x in enumerate(ids) if x in wanted]
            for a, b, buf, offsets in chunks(batch.column("text").take(pa.array(rows, pa.int64()))):
                for k, items in zip(rows[a:b], shingle_sets(buf, offsets, size), strict=True):
                    node = wanted[ids[k]].pop(_class_key(items), None)  # once, if rows repeat
                    if node is not None and len(items):
                        nodes.append(node)
                        sets.append(items)
        ends = np.cumsum([len(x) for x in sets])
        give_back()
        return pa.table({"node": pa.array(nodes, pa.int64()), "shingles": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(np.concatenate(sets))))})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node's smallest reachable node, for undirected links (a, b) of any ordered type.

    Every round takes the least root among a node's neighbours and then the root of that root, with a
    checkpoint; the driver sees only whether a row changed. Stars around their smallest node need one round.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")).select("node", "root")
    while True:
        roots = cut(roots)
        near = both.join(roots, both.b == roots.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        up = roots.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = low.join(up, "low", "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("root"))
        new = cut(new)
        if new.where("old != root").isEmpty():
            return roots
        roots = new.select("node", "root")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose nodes' full sets reach the threshold."""
    one = sets.select(F.col("node").alias("one"), F.col("shingles").alias("p"))
    two = sets.select(F.col("node").alias("two"), F.col("shingles").alias("q"))
    both = F.size(F.array_intersect("p", "q"))
    met = pairs.join(one, F.col("b") == one.one).join(two, F.col("a") == two.two)
    return met.where((100 + percent) * both >= percent * (F.size("p") + F.size("q"))).select(*pairs.columns)


def _prefixes(percent: int, heavy: list[int]):
    """Each node's prefix, as rows with the shingle, its position and the parities of the whole set.

    Shingles are ordered by how common they are, those that ``heavy`` lists (from rare to common) last. A set that
    shares ``percent`` of its n shingles with another shares one of its first n - ceil(percent * n / 100) + 1.
    """
    keys = np.array(heavy, np.int64).view(np.uint64)
    by = np.argsort(keys)
    keys = keys[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[] for _ in range(3)]
            parities = np.zeros((batch.num_rows, 8), np.int64)
            for k, x in enumerate(batch.column("shingles")):
                items = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.minimum(np.searchsorted(keys, items), max(len(keys) - 1, 0))
                rank = np.where(keys[at] == items, by[at] + 1, 0) if len(keys) else np.zeros(len(items), int)
                first = np.lexsort((items, rank))[: len(items) - -(-percent * len(items) // 100) + 1]
                parities[k] = np.packbits((np.bincount((items >> np.uint64(7) & np.uint64(511)).astype(np.intp), minlength=512) & 1).astype(np.uint8)).view(np.int64)
                for out, value in zip(rows, (np.full(len(first), k), np.arange(len(first)), signed(items[first])), strict=True):
                    out.append(value)
            row, place, shingle = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows)
            own = [batch.column(c).take(pa.array(row)) for c in ("node", "root", "n")]
            yield pa.record_batch([*own, pa.array(place, pa.int32()), pa.array(shingle), *(pa.array(parities[row, i]) for i in range(8))], names=["node", "root", "n", "place", "s", *(f"p{i}" for i in range(8))])
        give_back()

    return run


def _open_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, x, y) of nodes with different roots x and y that may reach the threshold, for ``nodes`` (node, root, n).

    Two nodes meet at a shingle of both prefixes. A pair is left out only where arithmetic forbids a link: what follows the
    first common shingle is too short, or the sets differ in more shingles than a link allows, because each differing parity of
    their shingles by bucket needs one shingle of its own.
    """
    sized = sets.join(nodes, "node").select("node", "root", "n", "shingles")
    common = sized.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    heavy = [r.s for r in common.orderBy(F.desc("n"), "s").limit(HEAVY).collect()][::-1]
    kinds = dict((f.name, f.dataType.simpleString()) for f in nodes.schema)
    rows = sized.mapInArrow(_prefixes(percent, heavy), f"node long, root {kinds['root']}, n long, place int, s long, " + ", ".join(f"p{i} long" for i in range(8)))
    left = F.least(F.col("h.n") - F.col("h.place"), F.col("m.n") - F.col("m.place"))
    apart = sum((F.bit_count(F.col(f"h.p{i}").bitwiseXOR(F.col(f"m.p{i}"))) for i in range(8)), F.lit(0))
    sizes = F.col("h.n") + F.col("m.n")
    may = ((100 + percent) * left >= percent * sizes) & ((100 + percent) * apart <= (100 - percent) * sizes)
    pairs = rows.alias("h").join(rows.alias("m"), (F.col("h.s") == F.col("m.s")) & (F.col("h.node") < F.col("m.node")) & (F.col("h.root") != F.col("m.root")) & may)
    return pairs.select(F.col("h.node").alias("a"), F.col("m.node").alias("b"), F.col("h.root").alias("x"), F.col("m.root").alias("y")).distinct()


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of the nodes that have a link, given bucket members (bucket, node, n, shared, central) and the nodes' sets.

    Each bucket's most central node is its hub, and the others are verified against it: that makes a component of a base text and
    its copies in one round. Members of buckets that are still of different components meet once more at their prefixes.
    """
    place = F.struct((-F.col("central")).alias("far"), F.col("node").alias("id"))
    members = cut(members.select("bucket", place.alias("node"), "n", "shared"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n", "shared")).alias("hub"))
    pairs = members.join(hubs, "bucket").where(
        (F.col("node") != F.col("hub.node"))
        # |A & B| is at most what either shares with anyone, and at least percent/(100 + percent) of |A| + |B|
        & ((100 + percent) * F.least("shared", "hub.shared") >= percent * (F.col("n") + F.col("hub.n")))
    )
    pairs = pairs.select(F.col("hub.node").alias("x"), F.col("node").alias("y")).distinct().select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x", "y")
    links = cut(_near(pairs, sets, percent).select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = components(links) if not links.isEmpty() else None

    rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots else members.withColumn("root", F.col("node"))
    rows = cut(rows.select("bucket", "node", "root", "n"))
    open_ = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    nodes = cut(rows.join(open_, "bucket", "left_semi").select(F.col("node.id").alias("node"), "root", "n").distinct())
    if nodes.isEmpty():
        return roots
    found = cut(_near(_open_pairs(nodes, sets, percent), sets, percent).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if found.isEmpty():
        return roots
    new = components(found)  # of the roots so far
    if not roots:
        return new
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(moved.unionAll(new).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, by_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups of documents linked by similar shingle sets.

    Two rows are linked if 100 * |A & B| >= percent * |A | B| over their distinct shingles of words with A-Z lowered; a text
    with fewer words is one shingle. component_id is the smallest doc_id reachable. Texts without a word (or
    null) are linked with nothing. A row with a null doc_id links nothing and has a null component_id; it is
    kept. Rows that share a doc_id stay rows of their own. Other columns are not read.

    A pair at the threshold of 80 % is missed by all 32 bands with probability 5e-8; no pair that meets in a
    band is left out unless it is verified, in one component already or cannot reach the threshold.

    ``by_row`` adds content (xxhash64 of the text) and root, which tells components apart even if they have the same smallest
    doc_id; root is null for a row that links nothing for want of a word or an id.
    """
    more = [F.xxhash64("text").alias("content")] if by_row else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>" + ", content long" * by_row
    sketched = cut(docs.mapInArrow(_sketched(shingle, bands, rows), schema))
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("n_shingles").alias("n"), "doc", "bands"))

    met = classes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all")).where("size > 1")
    buckets = met.join(buckets, "bucket")
    # bands in which the same classes meet are one bucket
    members = buckets.groupBy("node", "n", "size", "lo", "hi", "all").agg(F.min("bucket").alias("bucket"), F.count("*").alias("bands"))
    members = cut(members.select("bucket", "node", "n", (F.col("size") * F.col("bands")).alias("met")))
    # how many meetings a node has grows with its similarity to the others: the base of a group has most
    active = members.groupBy("node").agg(F.sum("met").alias("central")).join(classes.select("node", "doc", "s1", "s2"), "node")
    active = cut(active)

    packed, blocks = packed_blocks(docs)
    asked = active.select("node", "doc", "s1", "s2").withColumn("block", block_of(F.col("doc"), F.lit(0).cast("long"), blocks))
    sets = cut(packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_sets(shingle), "node long, shingles array<long>"))
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    known = active.select("node", "central").join(alone, "node", "left")
    members = members.join(known, "node").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("shared") * 100 >= F.col("n") * percent)
    # a link needs (100 + percent) * shared >= percent * (n + the partner's n), and a partner is at least as large as the bucket's smallest
    members = cut(members.select("bucket", "node", "n", "shared", "central"))
    smallest = members.groupBy("bucket").agg(F.min("n").alias("low"), F.count("*").alias("size")).where("size > 1")
    members = members.join(smallest, "bucket").where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("low")))
    roots = _linked(members, sets, percent)

    own = classes.select("node", "s1", "s2", "n", "doc")
    if roots is not None:
        roots = roots.select(F.col("node.id").alias("node"), F.col("root.id").alias("root"))
        group = roots.join(own.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("component"))
        own = own.join(roots.join(group, "root").select("node", "root", "component"), "node", "left")
    else:
        own = own.withColumn("component", F.col("doc")).withColumn("root", F.col("node"))
    own = own.select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"), F.coalesce("root", "node").alias("root"))
    out = sketched.select("doc_id", "n_shingles", "s1", "s2", *["content"] * by_row).join(own, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["content", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root")] if by_row else []))
