"""Substring deduplication by compaction of a De Bruijn graph of word windows.

Every window of ``window`` consecutive words is an edge of a De Bruijn graph whose nodes are the
windows one word shorter. Storing each edge on its own would shuffle a row per word of the corpus, so
the graph is kept compacted from the start, as genome assemblers do:

1. Consecutive edges of a document that share their minimiser (the least hash among the ``anchor``-word
   grams inside the window) form one path. Equal windows have equal minimisers, so a repeated edge can
   only lie on paths with the same minimiser. About one row in ``(window - anchor + 2) / 2`` words is left.
2. A grouped aggregation by minimiser keeps those that occur in two documents or more and tells
   whether all their paths are equal (nonbranching) or not.
3. A join sends that back to the paths. On a nonbranching minimiser a whole path is decided by its
   smallest document. On a branching one, copies of a path are decided by the smallest document that
   has the same path, and only that document's own path is expanded into single edges with their nodes.
4. Of these, a grouped aggregation keeps the edges that are repeated and finds the source of each. The degrees of their nodes are
   counted and joined, and a join sends nodes with one edge in and one out back to the edges: repeated edges of a
   document that meet at such a node and have one source are compacted to one path.
5. Paths carry coordinates (document, first word, number of edges) and 128 bits of hash, equal to
   those of the source's words; neighbouring ones are glued to long spans when the text is read again, and
   a span counts only if the words at its coordinates have those hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, block_of, chunks, cut, packed_blocks, signed, sliding_min, unpacked

PATHS = "doc long, start int, edges int, anchor long, h1 long, h2 long"
_PATHS = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("edges", pa.int32()), ("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
EDGES = "doc long, content int, start int, h1 long, h2 long, head int, tail int"
_EDGES = pa.schema([(x, pa.int64() if x in ("doc", "h1", "h2") else pa.int32()) for x in ("doc", "content", "start", "h1", "h2", "head", "tail")])


def _paths(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                if not len(w) or w.counts.max() < window:
                    continue
                left = w.first[1:][w.doc] - np.arange(len(w))  # words from here to the document's end
                lanes = [w.sequence(0), w.sequence(1)]
                grams = np.full(len(w), np.iinfo(np.uint64).max)
                whole = np.flatnonzero(left >= anchor)
                grams[whole] = lanes[0][0].ranges(lanes[0][1], whole, whole + anchor)
                least = sliding_min(grams, window - anchor + 1)
                at = np.flatnonzero(left >= window)
                new = np.ones(len(at), bool)
                new[1:] = (least[at[1:]] != least[at[:-1]]) | (np.diff(at) != 1)
                begin = at[new]
                edges = np.diff(np.append(np.flatnonzero(new), len(at)))
                end = begin + edges + window - 1
                doc = w.doc[begin]
                yield pa.record_batch([pa.array(ids[a:b][doc].astype(np.int64)), pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(signed(least[begin])), *(pa.array(signed(lane.ranges(sums, begin, end))) for lane, sums in lanes)], schema=_PATHS)

    return run


class _At:
    """The rows of a table of coordinates (doc, start, edges, h1, h2, folded), by document.

    The hashes are those of the words or, if ``folded``, of each window's words, joined by exclusive or.
    """

    def __init__(self, rows: pa.Table, window: int):
        doc, self.start, edges, *hashes = (rows.column(c).to_numpy() for c in ("doc", "start", "edges", "h1", "h2"))
        order = np.argsort(doc, kind="stable")
        self.doc, self.start, self.size = doc[order], self.start[order], (edges + window - 1)[order]
        self.hashes, self.window = [h[order] for h in hashes], window
        self.folded = rows.column("folded").to_numpy(zero_copy_only=False)[order] if "folded" in rows.column_names else np.zeros(len(order), bool)

    def has(self, doc: int | None) -> bool:
        return doc is not None and (k := np.searchsorted(self.doc, doc)) < len(self.doc) and self.doc[k] == doc

    def of(self, doc: int, base: int, n: int, lanes) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of a document's rows, if the words there have both of the row's hashes, which are its source's.

        The document has ``n`` words, from ``base`` on in the sums of ``lanes``.
        """
        a, b = (np.searchsorted(self.doc, doc, side) for side in ("left", "right"))
        start, size = self.start[a:b], self.size[a:b]
        same = start + size <= n
        first, last = base + np.where(same, start, 0), base + np.where(same, start + size, 0)
        folded = self.folded[a:b] & same
        for (lane, sums), h in zip(lanes, self.hashes, strict=True):
            found = signed(lane.ranges(sums, first, last))
            if folded.any():
                at = np.arange(base, base + n - self.window + 1)
                each = np.append(0, np.bitwise_xor.accumulate(signed(lane.ranges(sums, at, at + self.window))))
                begin = start[folded]
                found[folded] = each[begin] ^ each[begin + size[folded] - self.window + 1]
            same &= found == h[a:b]
        return start[same], size[same]


def _expand(window: int):
    """The single edges of the paths asked for in a block's documents, each with its two nodes: the window without its last and its first word."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        found, at = [_EDGES.empty_table()], _At(asked, window)
        for batch in unpacked(texts.column("piece")) if len(asked) else ():
            ids = batch.column("doc_id").to_pylist()
            for a, b, buf, offsets in chunks(batch.column("text")):
                rows = [row for row in range(a, b) if at.has(ids[row])]
                if not rows:
                    continue
                w = Words(buf, offsets)
                lanes = w.sequence(0), w.sequence(1)
                for row in rows:
                    base = w.first[row - a]
                    start, size = at.of(ids[row], base, w.counts[row - a], lanes)
                    edges = size - window + 1
                    each = np.repeat(start - np.append(0, np.cumsum(edges)[:-1]), edges) + np.arange(edges.sum())
                    i = base + each
                    # nodes that share 32 bits pass for one with more edges, which only ends a path
                    nodes = [signed(lanes[0][0].ranges(lanes[0][1], i + k, i + k + window - 1)).astype(np.int32) for k in (0, 1)]
                    content = signed(lanes[0][0].ranges(lanes[0][1], np.array([base]), np.array([base + w.counts[row - a]])))[0].astype(np.int32)
                    found.append(pa.table([pa.array(np.full(len(each), ids[row], np.int64)), pa.array(np.full(len(each), content)), pa.array(each.astype(np.int32)), *(pa.array(signed(x.ranges(y, i, i + window))) for x, y in lanes), *map(pa.array, nodes)], schema=_EDGES))
        return pa.concat_tables(found)

    return run


def repeated_paths(docs: DataFrame, packed: DataFrame, blocks: int, window: int = 50, anchor: int = 12) -> DataFrame:
    """(doc, start, edges, h1, h2, folded): the windows of each document that also start in one with a smaller id.

    ``start`` is the first window's first word, ``edges`` the number of consecutive windows, ``h1`` and ``h2`` the
    hashes of their words, which are those of the source's words; if ``folded``, the hashes of each window's words, joined by exclusive or. Rows with a null doc_id or text are neither sources nor targets. ``packed`` and
    ``blocks`` are the same documents as ``packed_blocks`` gives them.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    paths = docs.mapInArrow(_paths(window, anchor), PATHS)
    repeated = (
        paths.groupBy("anchor")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d"))
        .where("lo < hi")
        .select("anchor", "lo", ((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("branching"))
    )
    mine = cut(paths.join(repeated, "anchor").drop("anchor"))
    straight = mine.where("not branching and doc > lo").select("doc", "start", "edges", "h1", "h2")

    branching = mine.where("branching")
    source = branching.groupBy("h1", "h2").agg(F.min("doc").alias("source"))
    branching = branching.join(source, ["h1", "h2"])
    copies = branching.where("doc > source").select("doc", "start", "edges", "h1", "h2")
    asked = branching.where("doc = source").select("doc", "start", "edges", "h1", "h2").withColumn("block", _block(blocks))
    edges = packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_expand(window), EDGES)
    whole = straight.unionByName(copies).withColumn("folded", F.lit(False))
    return whole.unionByName(_compacted(edges).withColumn("folded", F.lit(True)))


def _compacted(edges: DataFrame) -> DataFrame:
    """(doc, start, edges, h1, h2): the repeated edges of each document that start in a smaller one too, compacted along nonbranching nodes."""
    graph = edges.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("head").alias("head"), F.first("tail").alias("tail")).where("lo < hi")
    out = graph.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("out")).where("out = 1")
    into = graph.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("into")).where("into = 1")
    passed = out.join(into, "node").select(F.col("node").alias("head"), F.lit(True).alias("passed"))
    flagged = graph.select("h1", "h2", "lo", "head").join(passed, "head", "left").select("h1", "h2", "lo", "passed")
    mine = edges.select("doc", "content", "start", "h1", "h2").join(flagged, ["h1", "h2"]).where("doc > lo")
    order = Window.partitionBy("doc", "content").orderBy("start")  # rows that share an id may have different texts
    goes_on = F.coalesce((F.lag("start").over(order) == F.col("start") - 1) & (F.lag("lo").over(order) == F.col("lo")) & F.col("passed"), F.lit(False))
    paths = mine.dropDuplicates(["doc", "content", "start"]).withColumn("new", (~goes_on).cast("int")).withColumn("path", F.sum("new").over(order))
    return paths.groupBy("doc", "content", "path").agg(F.min("start").alias("start"), F.count("*").cast("int").alias("edges"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).drop("content", "path")


def _block(blocks: int):
    return block_of(F.col("doc"), F.lit(0).cast("long"), blocks)


def _apply(window: int, texts: bool):
    def run(pieces: pa.Table, spans: pa.Table) -> pa.Table:
        at, keys = _At(spans, window), []
        words, removed, digest, kept_text, gone_spans = [], [], [], [], []
        for batch in unpacked(pieces.column("piece")):
            ids = batch.column("doc_id").to_pylist()
            keys += ids
            for a, b, buf, offsets in chunks(batch.column("text")):
                w = Words(buf, offsets)
                lanes = [w.sequence(k) for k in (0, 1)] if any(map(at.has, ids[a:b])) else []
                data = buf.tobytes()
                for row in range(a, b):
                    base, n = w.first[row - a], int(w.counts[row - a])
                    out = data[offsets[row - a] : offsets[row - a + 1]].split()
                    runs = []
                    if at.has(ids[row]) and len((found := at.of(ids[row], base, n, lanes))[0]):
                        start, size = found
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, start, 1)
                        np.add.at(change, start + size, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        out = [out[i] for i in np.flatnonzero(~gone)]
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
                        runs = [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]
                    kept = b" ".join(out)
                    words.append(n)
                    removed.append(n - len(out))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_text.append(kept.decode())
                        gone_spans.append(runs)
        out = {"doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if texts:
            out |= {"kept_text": pa.array(kept_text, pa.string()), "removed_spans": pa.array(gone_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(out)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, anchor: int = 12, texts: bool = True) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (kept words joined by
    a space) and removed_spans (glued spans in words, end exclusive). Other input columns are not
    read. A null text has no words; a row with a null doc_id keeps all its words; rows that share a
    doc_id are one document, and each loses the spans found at its own coordinates. An empty table
    gives an empty result.
    """
    packed, blocks = packed_blocks(docs)
    spans = repeated_paths(docs, packed, blocks, window, anchor).withColumn("block", _block(blocks))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string, removed_spans array<struct<start: int, end: int>>" * texts
    return packed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_apply(window, texts), schema)
