"""Quality rules with cross-document line frequency.

Base statistics of each text are computed where it lies. Each document also lists its distinct normalised lines;
grouped aggregation counts in how many distinct documents of a host a line occurs, lines above the limit
are removed, and a document that they deplete is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, signed

#: A line in more distinct documents of a host than this is boilerplate.
LINE_LIMIT = 100
#: A document is depleted if less than this share of its words, or fewer than MIN_WORDS, is left.
LEAST_LEFT = 0.3
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Hashes of frequent lines that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.arange(256) & 0xC0 != 0x80  # bytes that begin a code point
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_NORMAL = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeated(hashes: np.ndarray, width: int) -> int:
    """Words covered by windows whose hash occurs twice or more."""
    n = len(hashes)
    if n < 2:
        return 0
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(n + width, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int((np.cumsum(change) > 0).sum())


def _normal(line: bytes) -> list[bytes]:
    """The words of a normalised line."""
    return line.translate(_NORMAL).split()


def _measured(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, data = Words(buf, offsets), buf.tobytes()
                lane, sums = w.sequence(0)
                per_doc = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
                chars, symbols = per_doc(_HEAD[buf] & ~_GAP[buf]), per_doc(_SYMBOL[buf])
                windows = np.arange(max(0, len(w) - width + 1))
                hashes = lane.ranges(sums, windows, windows + width)
                repeats, doubled, lines, words = [], [], [], []
                for k in range(b - a):
                    first, n = w.first[k], w.counts[k]
                    repeats.append(_repeated(hashes[first : first + n - width + 1], width) if n > width else 0)
                    seen: Counter[bytes] = Counter()
                    again, raw = 0, set()
                    for line in data[offsets[k] : offsets[k + 1]].split(b"\n"):
                        parts = _normal(line)
                        if parts:
                            again += line in raw
                            raw.add(line)
                            seen[b" ".join(parts)] += len(parts)
                    doubled.append(again)
                    lines.append(np.array([xxhash.xxh3_64_intdigest(x) for x in seen], np.uint64))
                    words.append(list(seen.values()))
                ends = pa.array(np.cumsum([0, *map(len, lines)]).astype(np.int32))
                numbers = [w.counts, chars, symbols, doubled, repeats]
                names = ["doc_id", "source", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
                arrays = [batch.column(c)[a:b] for c in names[:3]] + [pa.array(np.asarray(x, np.int64)) for x in numbers]
                arrays += [pa.ListArray.from_arrays(ends, pa.array(signed(np.concatenate(lines)))), pa.ListArray.from_arrays(ends, pa.array([x for y in words for x in y], pa.int32()))]
                yield pa.record_batch(arrays, names=names)

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the lines whose hashes are in ``gone``, those lines in order, and the number of their words."""
    for batch in batches:
        kept, lost, words = [], [], []
        for text, gone in zip(batch.column("text").cast(pa.binary()), batch.column("gone"), strict=True):
            text, gone = text.as_py(), set(gone.as_py() or ())
            out, away, n = [], [], 0
            for line in text.split(b"\n") if gone else ():
                parts = _normal(line)
                if parts and int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(parts))).view(np.int64)) in gone:
                    away.append(line)
                    n += len(parts)
                else:
                    out.append(line)
            kept.append(b"\n".join(out) if gone else text)
            lost.append(away)
            words.append(n)
        fields = [f for f in batch.schema if f.name not in ("text", "gone")]
        arrays = [batch.column(f.name) for f in fields] + [pa.array(words, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lost, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
        yield pa.record_batch(arrays, names=[*(f.name for f in fields), "n_removed", "kept_text", "removed_lines"])


def quality(docs: DataFrame, line_limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT, min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT, texts: bool = False) -> DataFrame:
    """The base statistics of every row, with n_removed (words in frequent lines), base_failed and kept.

    With ``texts`` also kept_text (the text without its frequent lines, the others as they are, joined by line feeds; null for
    a null text) and removed_lines (those lines as they stood, in order), of rejected rows too.

    A line is frequent if more than ``line_limit`` documents of its host have it; rows that share a doc_id are one document to that
    count, and so are rows without an id that share a text. The host is ``source``; null is a host of its own. A null text has no words and fails the base rules. Rows with a null
    doc_id and repeated rows are judged like any others. Other columns are not read.
    """
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("content"), text.alias("text"))
    rows = cut(named.mapInArrow(_measured(5), f"doc_id long, source string, content long, {_BASE}, lines array<long>, line_words array<int>"))
    one = F.arrays_zip(F.col("lines").alias("hash"), F.col("line_words").alias("words"))
    # rows of equal doc_id, source and text have equal lines, so one of them stands for all
    mine = F.xxhash64(F.lit(7), "doc_id", "content", F.coalesce("source", F.lit("")), F.col("source").isNull())
    document = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(1), "doc_id")).otherwise(F.xxhash64(F.lit(2), "content"))
    lines = rows.select(mine.alias("own"), document.alias("document"), "source", F.inline(one)).withColumn("line", F.xxhash64("source", "hash"))
    frequent = cut(lines.groupBy("line").agg(F.count_distinct("document").alias("n")).where(F.col("n") > line_limit).select("line"))
    # a frequent line is in more than line_limit documents, so there are few; beyond the limit they are joined by a shuffle
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    removed = lines.join(frequent, "line").groupBy("own", "line").agg(F.first("words").alias("words"), F.first("hash").alias("hash"))
    removed = removed.groupBy("own").agg(F.sum("words").alias("n_removed"), F.collect_list("hash").alias("gone"))
    base = [x.split()[0] for x in _BASE.split(", ")]
    out = rows.withColumn("own", mine)
    more = []
    if texts:
        of_text = out.select("own", *base).dropDuplicates(["own"]).join(removed.select("own", "gone"), "own", "left")
        out = named.select("doc_id", "text", mine.alias("own")).join(of_text, "own").select("doc_id", *base, "text", "gone")
        out = out.mapInArrow(_without, f"doc_id long, {_BASE}, n_removed long, kept_text string, removed_lines array<string>")
        more = ["kept_text", "removed_lines"]
    else:
        out = out.join(removed.select("own", "n_removed"), "own", "left")
    gone = F.coalesce("n_removed", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated_percent)
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < min_words) | (left < F.col("n_words") * least_left))
    return out.select("doc_id", *base, gone.alias("n_removed"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *more)
