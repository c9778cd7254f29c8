"""Phrase collocations by suffix automata of shards, whose counts are reduced over all shards.

1. Tasks split their texts into pieces and words and gather them into shards of one language and a bounded size.
2. Each shard lists its distinct words; lists are dealt by a hash of the word, counts are summed over all shards and every word
   that is frequent enough gets a number, which goes back to the shards that listed it. A phrase is frequent only if its
   words are, so rarer words end pieces from here on.
3. Each shard builds a suffix automaton of its pieces, bounded in depth, and enumerates its phrases with the sizes of
   their sets of end positions. Lists of phrases travel packed, are dealt by a hash of the phrase and summed.
4. What is frequent over all shards is scored by joins along suffix links (a phrase without its first word) and
   prefixes (without its last one), the same way on which a longer phrase tells its parts that it subsumes them.

Words are numbered, not hashed, so that nothing rests on hashes being distinct.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, cut, give_back, mix

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 6 << 20
#: Bytes of listed words, and phrases with their copies in other shards, that a task sums at once.
PART_BYTES = 24 << 20
PART_PHRASES = 1 << 21
#: Ranges that a language's phrases are dealt into before its first ones are taken.
RANKED_PARTS = 64

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[9, 32]] = True
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_SHARD = "shard string, lang string, n long, words binary, pieces binary"


def _distinct(key: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first occurrence, place among the distinct ones of each, number of occurrences) of the distinct keys, in their order."""
    order = np.argsort(key, kind="stable").astype(kind)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    begins = np.flatnonzero(new).astype(kind)
    inverse = np.empty(len(order), kind)
    inverse[order] = np.cumsum(new, dtype=kind) - kind(1)
    return order[begins], inverse, np.diff(begins, append=kind(len(order)))


class SuffixAutomaton:
    """The suffix automaton of a set of word sequences, for phrases of at most ``depth`` words.

    ``ids`` has the words of all sequences, ``start`` tells for each word whether it begins one. A state is a set of end positions; its phrases
    are the suffixes of its longest one that are longer than its suffix link's longest. States are found by refining sets of end positions by the word
    that precedes, which is how the tree of suffix links branches; a phrase that a single word always precedes has no set of its own.
    """

    def __init__(self, ids: np.ndarray, start: np.ndarray, depth: int):
        n = len(ids)
        kind = np.int32 if n * depth < 1 << 31 else np.int64
        place = np.arange(n, dtype=kind)
        room = place - np.maximum.accumulate(np.where(start, place, 0)) + 1 if n else place  # words of the sequence up to here
        node_at, first = None, 0
        counts, parents, last, depths = [], [], [], []
        for d in range(1, depth + 1):
            ends = np.flatnonzero(room >= d).astype(kind)
            key = ids[ends - (d - 1)].astype(np.int64)
            if d > 1:
                key += node_at[ends].astype(np.int64) * (int(ids.max(initial=0)) + 1)
            at, inverse, count = _distinct(key, kind)
            del key
            parents.append(np.full(len(at), -1, kind) if d == 1 else node_at[ends[at]] + kind(before))
            counts.append(count)
            last.append(ends[at])
            depths.append(np.full(len(at), d, np.int8))
            node_at = np.zeros(n, kind)
            node_at[ends] = inverse
            before, first = first, first + len(at)
            del ends, at, inverse, count
        del node_at, room, place
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, kind)
        count, self.last, self.depth = joined(counts), joined(last), joined(depths)
        self._parent = parent = joined(parents)
        del counts, last, depths, parents
        #: The state of each phrase: its own, or that of the longer phrase that ends wherever it ends.
        self.state = np.arange(len(count), dtype=kind)
        whole = np.flatnonzero((parent >= 0) & (count == count[np.maximum(parent, 0)]))
        for d in range(depth, 1, -1):
            child = whole[self.depth[whole] == d]
            self.state[parent[child]] = self.state[child]
        self.endpos = count

    @cached_property
    def states(self) -> np.ndarray:
        return np.unique(self.state)

    @cached_property
    def link(self) -> np.ndarray:
        """The suffix link of each state."""
        inner = np.flatnonzero(self._parent >= 0)
        shortest = inner[self.state[self._parent[inner]] != self.state[inner]]  # the shortest phrase of its state
        out = np.full(len(self.state), -1, self.state.dtype)
        out[self.state[shortest]] = self.state[self._parent[shortest]]
        return out

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, last position of one occurrence, number of occurrences) of every distinct phrase, shortest first.

        A state lends its phrases the size of its set of end positions.
        """
        for d in range(1, int(self.depth.max(initial=0)) + 1):
            own = np.flatnonzero(self.depth == d)
            yield d, self.last[own], self.endpos[self.state[own]]


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a run of texts, and whether each begins a piece; A-Z are lowered."""
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    w = Words(buf, offsets, _BETWEEN | _ENDS_PIECE)
    piece = np.cumsum(_ENDS_PIECE[buf], dtype=np.int32 if len(buf) < 1 << 31 else np.int64)[w.start] if len(w) else np.zeros(0, int)
    start = np.ones(len(w), bool)
    start[1:] = (np.diff(piece) > 0) | (np.diff(w.doc) > 0)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    kept = buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), start


def _packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"\n".join(words))


def _unpacked_words(packed) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed.as_buffer()).split(b"\n")


def _shards(most: int) -> Callable:
    """Shards of (language, text) batches. ``words`` has the distinct words, ``pieces`` each word's place among them times two, plus one if it begins a piece."""

    def close(task: int, number: int, lang: str, held: list) -> pa.RecordBatch:
        words = pa.concat_arrays([x for x, _ in held]).dictionary_encode()
        start = np.concatenate([x for _, x in held])
        codes = words.indices.to_numpy().astype(np.int64) * 2 + start
        code = np.uint32 if len(words.dictionary) < 1 << 31 else np.uint64
        pieces = zstandard.ZstdCompressor(1).compress(code().dtype.str.encode() + codes.astype(code).tobytes())
        row = {"shard": [f"{task}:{number}"], "lang": [lang], "n": pa.array([len(codes)], pa.int64()), "words": pa.array([_packed_words(words.dictionary.to_pylist())], pa.binary()), "pieces": pa.array([pieces], pa.binary())}
        return pa.record_batch(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy() == code)
                for _, _, buf, offsets in chunks(batch.column("text").take(pa.array(rows)), most):
                    words, start = _tokens(buf, offsets)
                    if len(words):
                        held.setdefault(lang, []).append((words, start))
                        size[lang] = size.get(lang, 0) + len(buf)
                    while held and (size.get(lang, 0) >= most or sum(size.values()) >= 2 * most):
                        full = lang if size.get(lang, 0) >= most else max(size, key=size.get)
                        size.pop(full)
                        yield close(task, number := number + 1, full, held.pop(full))
        for lang, own in held.items():
            yield close(task, number := number + 1, lang, own)
        held.clear()
        give_back()

    return run


def _codes(packed) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(packed.as_buffer())
    return np.frombuffer(data, data[:3].decode(), offset=3).astype(np.int64)


def _listed(parts: int) -> Callable:
    """A shard's distinct words with their counts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, packed, pieces in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang")), batch.column("words"), batch.column("pieces"), strict=True):
                words = _unpacked_words(packed)
                counts = np.bincount(_codes(pieces) >> 1, minlength=len(words))
                part = _part_of_words(words, parts)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own = order[a:b].tolist()
                    row = {"shard": [shard], "lang": [lang], "part": pa.array([int(part[own[0]])], pa.int32()), "words": pa.array([_packed_words([words[k] for k in own])], pa.binary()), "counts": pa.array([counts[own].astype("<i8").tobytes()], pa.binary())}
                    yield pa.record_batch(row)

    return run


def _part_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _numbered(parts: int, least: int) -> Callable:
    """Sum the lists of one part. Replies to shards have each listed word's number, or -1; a row without a shard has a frequent word."""

    def run(lists: pa.Table) -> pa.Table:
        part, langs = lists.column("part")[0].as_py(), lists.column("lang").to_pylist()
        split = [_unpacked_words(x) for x in lists.column("words")]
        counts = [np.frombuffer(x.as_buffer(), "<i8") for x in lists.column("counts")]
        total: dict[tuple[str, bytes], int] = {}
        for lang, words, own in zip(langs, split, counts, strict=True):
            for word, n in zip(words, own.tolist(), strict=True):
                total[lang, word] = total.get((lang, word), 0) + n
        kept = sorted(k for k, n in total.items() if n >= least)
        number = {k: rank * parts + part for rank, k in enumerate(kept)}  # no two parts share a number
        replies = [np.fromiter((number.get((lang, w), -1) for w in words), np.int64, len(words)).tobytes() for lang, words in zip(langs, split, strict=True)]
        m, n = len(kept), len(split)
        columns = {
            "shard": pa.array([*lists.column("shard").to_pylist(), *[None] * m], pa.string()),
            "part": pa.array([part] * (n + m), pa.int32()),
            "numbers": pa.array([*replies, *[None] * m], pa.binary()),
            "lang": pa.array([*[None] * n, *(k[0] for k in kept)], pa.string()),
            "word": pa.array([*[None] * n, *(k[1].decode() for k in kept)], pa.string()),
            "id": pa.array([*[None] * n, *(number[k] for k in kept)], pa.int64()),
            "f": pa.array([*[None] * n, *(total[k] for k in kept)], pa.int64()),
        }
        return pa.table(columns)

    return run


_NUMBERED = "shard string, part int, numbers binary, lang string, word string, id long, f long"


def _mined(word_parts: int, parts: int, depth: int) -> Callable:
    """A shard's phrases of 2 words and more, by part: rows of numbers, 0-padded from the left after adding 1, and counts."""

    def run(shard: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"part": [], "rows": [], "phrases": []}
        if len(shard):
            words, codes = _unpacked_words(shard.column("words")[0]), _codes(shard.column("pieces")[0])
            number, part = np.full(len(words), -1), _part_of_words(words, word_parts)
            for k, got in zip(replies.column("part").to_pylist(), replies.column("numbers"), strict=True):
                number[part == k] = np.frombuffer(got.as_buffer(), np.int64)
            del words
            ids, start = number[codes >> 1], (codes & 1).astype(bool)
            start[1:] |= ids[:-1] < 0  # a word after a rare one begins a piece
            start = start[ids >= 0] | (np.diff(np.flatnonzero(ids >= 0), prepend=-2) > 1)
            ids = ids[ids >= 0]
            del codes
            first, local, _ = _distinct(ids, np.int32 if len(ids) < 1 << 31 else np.int64)
            kind = np.uint32 if ids.max(initial=0) + 1 < 1 << 32 and len(ids) < 1 << 32 else np.uint64
            names = (ids[first] + 1).astype(kind)
            del ids, first
            automaton, rows, counts = SuffixAutomaton(local, start, depth), [np.zeros((depth, 0), kind)], [np.zeros(0, kind)]
            for d, last, count in automaton.phrases():
                if d > 1:
                    row = np.zeros((depth, len(last)), kind)
                    for k in range(d):
                        row[depth - 1 - k] = names[local[last - k]]
                    rows.append(row)
                    counts.append(count.astype(kind))
            del automaton, local, start
            rows, counts = np.concatenate(rows, axis=1), np.concatenate(counts)
            key = np.zeros(len(counts), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(depth):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[k].astype(np.uint64))
            key %= np.uint64(parts)
            of = key.astype(np.int32)
            del key
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=parts))
            squeeze = zstandard.ZstdCompressor(1).compress
            code = "<u4" if kind is np.uint32 else "<u8"
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                out["part"].append(int(of[own[0]]))
                out["rows"].append(b - a)
                out["phrases"].append(squeeze(code.encode() + np.vstack([rows[:, own], counts[own]]).astype(code).tobytes()))
            del rows, counts, of, order
        give_back()
        return pa.table({"part": pa.array(out["part"], pa.int32()), "rows": pa.array(out["rows"], pa.int64()), "phrases": pa.array(out["phrases"], pa.binary())})

    return run


def _summed(depth: int, least: int) -> Callable:
    """The phrases of one part that are frequent over all shards."""
    names = [f"w{k}" for k in range(depth)]

    def run(lists: pa.Table) -> pa.Table:
        expand, found = zstandard.ZstdDecompressor().decompress, []
        for packed in lists.column("phrases"):
            data = expand(packed.as_buffer())
            found.append(np.frombuffer(data, data[:3].decode(), offset=3).reshape(depth + 1, -1))
        table = pa.table(dict(zip([*names, "f"], np.concatenate(found, axis=1), strict=True)))
        del found
        table = table.group_by(names, use_threads=False).aggregate([("f", "sum")])
        table = table.filter(pc.greater_equal(table.column("f_sum"), least))
        give_back()
        return pa.table({c: table.column("f_sum" if c == "f" else c).cast(pa.int64()) for c in [*names, "f"]})

    return run


#: floor(scale * a * a / (l * r)) in whole numbers; the decimals hold it for counts up to 10 to the 15th.
_SCORE = "(cast({scale} as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))"


def _found(found: DataFrame, words: DataFrame, subsumed: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases of 2 and 3 words that no longer one subsumes."""
    w = lambda end: words.select(F.col("id").alias(f"w{end}"), F.col("word").alias(f"word{end}"), F.col("f").alias(f"f{end}"))
    score = lambda left, right: F.expr(_SCORE.format(scale=1_000_000, l=left, r=right))
    two = found.where("w0 = 0").select((F.col("w1") - 1).alias("w1"), (F.col("w2") - 1).alias("w2"), F.col("f").alias("a"))
    two = cut(two.join(w(1).join(words.select(F.col("id").alias("w1"), "lang"), "w1"), "w1").join(w(2), "w2"))
    three = found.where("w0 > 0").select(*((F.col(f"w{k}") - 1).alias(f"w{k}") for k in range(3)), F.col("f").alias("a"))
    # the suffix link of a phrase leads to it without its first word; its prefix leads on to it by its last word
    link = two.select("w1", "w2", F.col("a").alias("f12"), F.col("f2"), "word2")
    prefix = two.select(F.col("w1").alias("w0"), F.col("w2").alias("w1"), F.col("a").alias("f01"), F.col("f1").alias("f0"), "lang", F.concat_ws(" ", "word1", "word2").alias("head"))
    three = three.join(link, ["w1", "w2"]).join(prefix, ["w0", "w1"])
    three = three.withColumn("s1", score("f0", "f12")).withColumn("s2", score("f01", "f2"))
    early = F.col("s1") <= F.col("s2")
    scored = three.select("lang", F.concat_ws(" ", "head", "word2").alias("phrase"), "a", F.when(early, F.col("f0")).otherwise(F.col("f01")).alias("l"), F.when(early, F.col("f12")).otherwise(F.col("f2")).alias("r"), F.least("s1", "s2").alias("score"))
    longer = found.where("w0 > 0").select(F.col("w1"), F.col("w2"), "f").unionAll(found.where("w0 > 0").select(F.col("w0"), F.col("w1"), "f"))
    longer = longer.groupBy((F.col("w1") - 1).alias("w1"), (F.col("w2") - 1).alias("w2")).agg(F.max("f").alias("longer"))
    kept = two.join(longer, ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {subsumed} * a")
    return scored.unionByName(kept.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score")))


def collocations(docs: DataFrame, least: int = 10, subsumed: int = 50, most: int | None = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 and 3 words of each language.

    A phrase occurs ``a`` times within pieces, at least ``least`` times; ``n`` words occur in its language. Of its cuts in two, with ``l`` and ``r``
    occurrences, the one with the lowest floor(1,000,000 a a / (l r)) is given, of equal ones the earliest. A phrase is left out if a longer frequent one holds
    it and has ``subsumed`` percent of its occurrences. ``most`` limits each language to its first phrases by score, occurrences and phrase (bytes); None has all.

    A null text has no words, a null language is ``und``, repeated rows count each, ids and other columns are not read. An empty table gives an empty result.
    """
    depth, spark = 3, docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    shards = cut(texts.where(F.octet_length("text") > 0).mapInArrow(_shards(shard_bytes), _SHARD))
    size = shards.agg(F.sum("n").alias("n"), F.sum(F.octet_length("words")).alias("words")).first()
    out = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if not size.n:
        return spark.createDataFrame([], out)
    # compressed lists take about a third of their words
    word_parts = max(16, 3 * size.words // PART_BYTES + 1)
    parts = max(16, 2 * size.n // PART_PHRASES + 1)
    listed = shards.select("shard", "lang", "words", "pieces").mapInArrow(_listed(word_parts), "shard string, lang string, part int, words binary, counts binary")
    numbered = cut(listed.groupBy("part").applyInArrow(_numbered(word_parts, least), _NUMBERED))
    words = numbered.where("shard is null").select("lang", "word", "id", "f")
    replies = numbered.where("shard is not null").select("shard", "part", "numbers")
    mined = shards.select("shard", "words", "pieces").groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_mined(word_parts, parts, depth), "part int, rows long, phrases binary")
    found = cut(mined.groupBy("part").applyInArrow(_summed(depth, least), "w0 long, w1 long, w2 long, f long"))
    scored = _found(found, words, subsumed)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    if most is not None:  # each range of a language first, so that no language has to be sorted in one task
        near = scored.withColumn("__range", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
        near = near.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__range").orderBy(*order)))
        scored = near.where(F.col("__rank") <= most).drop("__range", "__rank")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
