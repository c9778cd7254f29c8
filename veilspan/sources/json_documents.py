"""Large JSON documents, an array or an object of arrays, read by many tasks.

Spark's text reader cuts a file at closing braces, in blocks that it finds by itself, wherever the file lies. Whether a block begins inside a string, and how
deep, depends on all that stands before. So each block first tells what it makes of each state that it may begin in; the driver puts these together, block after block, which
gives every block its true state; then all blocks give out the elements that begin and end in them, and pieces of those that don't, which
are put together by the block they begin in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import SLICE_BYTES, slices

#: Where a byte stands: outside of strings, in one, in one after a backslash.
OUT, IN, ESCAPED = 0, 1, 2
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
#: Bytes before an array in which its key is looked for.
_KEY_BYTES = 1 << 16


def scan(data: bytes, mode: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(+1, -1 or 0 for each byte that opens or closes something, commas between things, mode after the last byte)."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    back = b == 92
    if mode == ESCAPED and n:
        back = back.copy()
        back[0] = False
    # the character after an odd run of backslashes is escaped
    edge = np.flatnonzero(np.diff(np.concatenate([[False], back, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    odd = ends[(ends - begins) % 2 == 1]
    escaped = np.zeros(n + 1, bool)
    escaped[odd] = True
    escaped[0] |= mode == ESCAPED
    quotes = (b == 34) & ~escaped[:n]
    inside = (np.cumsum(quotes) + (mode != OUT)) % 2 == 1
    deeper = (((b == 123) | (b == 91)) & ~inside).astype(np.int8) - (((b == 125) | (b == 93)) & ~inside)
    last = (inside[-1] if n else mode != OUT) and (ESCAPED if escaped[n] and (n or mode == ESCAPED) else IN)
    return deeper, (b == 44) & ~inside, int(last)


Summary = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def summary(data: bytes) -> Summary:
    """(mode after, change of depth) for each mode before."""
    found = (scan(data, mode) for mode in (OUT, IN, ESCAPED))
    return tuple((last, int(deeper.sum())) for deeper, _, last in found)


def followed(a: Summary, b: Summary) -> Summary:
    return tuple((b[mode][0], depth + b[mode][1]) for mode, depth in a)


NOTHING: Summary = ((OUT, 0), (IN, 0), (ESCAPED, 0))


class Elements:
    """Goes through a block's bytes and cuts out the elements of the wanted array, ``depth`` deep.

    ``part`` is the key of the array in an object, None for an array that is the document. ``cuts`` counts where elements begin or end, ``opened`` has the last thing
    that was opened at that depth: its key and whether it is an array.
    """

    def __init__(self, mode: int, depth: int, target: int, part: bytes | None, opened: tuple[bytes, bool] | None):
        self.mode, self.depth, self.target, self.part, self.opened = mode, depth, target, part, opened
        self.cuts, self._held, self._before = 0, [], b""

    def wanted(self) -> bool:
        return self.depth >= self.target and (self.part is None or self.opened == (self.part, True))

    def feed(self, data: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whether it begins in this block, text) of the elements, or ends of elements, that end in the bytes."""
        deeper, commas, self.mode = scan(data, self.mode)
        depth = np.cumsum(deeper, dtype=np.int64) + self.depth
        opens = (deeper > 0) & (depth == self.target)
        closes = (deeper < 0) & (depth == self.target - 1)
        at, start = np.flatnonzero(opens | closes | commas & (depth == self.target)), 0
        for k in at.tolist():
            if not opens[k] and self.wanted():
                yield self.cuts > 0, b"".join(self._held) + data[start:k]
            self.cuts += 1
            self._held, start = [], k + 1
            self.depth = int(depth[k])
            if opens[k] and self.part is not None:
                key = _KEY.search((self._before + data[:k])[-_KEY_BYTES:] if k < _KEY_BYTES else data[k - _KEY_BYTES : k])
                self.opened = (key[1] if key else b"", data[k : k + 1] == b"[")
        self.depth = int(depth[-1]) if len(depth) else self.depth
        if self.wanted():
            self._held.append(data[start:])
        self._before = (self._before + data)[-_KEY_BYTES:] if self.part is not None else b""

    def left(self) -> bytes | None:
        """What of an unfinished element stands in the block."""
        return b"".join(self._held) if self.wanted() else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(block, bytes): a block's rows, each with the brace that it was cut at, in runs of bounded size that may end anywhere."""
    for batch in batches:
        for part in slices(batch, "value"):
            keys = zip(part.column("file").to_pylist(), part.column("block").to_pylist(), strict=True)
            rows = zip(keys, part.column("value").cast(pa.binary()).to_pylist(), strict=True)
            for key, own in groupby(rows, lambda x: x[0]):
                data = b"".join(v + b"}" for _, v in own)
                for k in range(0, len(data), SLICE_BYTES):
                    yield key, data[k : k + SLICE_BYTES]


_SUMMARY = "file string, block long, number long, summary array<int>, first string"
_OPENED = "file string, block long, cuts long, key binary, is_array boolean"
_PIECES = "file string, block long, begins long, place long, value binary"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, (key, own) in enumerate(groupby(_blocks(batches), lambda x: x[0])):
        whole, first = NOTHING, ""
        for _, data in own:
            whole = followed(whole, summary(data))
            first = first or data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
        flat = [x for pair in whole for x in pair]
        yield pa.record_batch({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "number": pa.array([number], pa.int64()), "summary": pa.array([flat], pa.list_(pa.int32())), "first": [first]})


def _opened(states: dict, target: int, part: bytes | None) -> Callable:
    """How many cuts each block has, and what it opened last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(_blocks(batches), lambda x: x[0]):
            elements = Elements(*states[key], target, part, None)
            for _, data in own:
                for _ in elements.feed(data):
                    pass
            last = elements.opened
            yield pa.record_batch({"file": [key[0]], "block": pa.array([key[1]], pa.int64()), "cuts": pa.array([elements.cuts], pa.int64()), "key": pa.array([last and last[0]], pa.binary()), "is_array": pa.array([last and last[1]], pa.bool_())})

    return run


def _pieces(states: dict, opened: dict, begun: dict, target: int, part: bytes | None) -> Callable:
    """Elements that are whole in a block have no ``begins``; pieces have the block that their element begins in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(_blocks(batches), lambda x: x[0]):
            if key not in states:
                raise RuntimeError("the file or spark.sql.files settings have changed since it was split")
            elements, rows = Elements(*states[key], target, part, opened.get(key)), []

            def table(rows: list[tuple], key=key) -> pa.RecordBatch:
                begins, place, value = zip(*rows, strict=True) if rows else ((), (), ())
                n = len(rows)
                return pa.record_batch({"file": pa.array([key[0]] * n, pa.string()), "block": pa.array([key[1]] * n, pa.int64()), "begins": pa.array(begins, pa.int64()), "place": pa.array(place, pa.int64()), "value": pa.array(value, pa.binary())})

            for _, data in own:
                for whole, text in elements.feed(data):
                    rows.append((None if whole else begun.get(key), len(rows), text))
                yield table(rows)
                rows = []
            left = elements.left()
            if left is not None:
                yield table([(key[1] if elements.cuts else begun.get(key), 1, left)])

    return run


def json_elements(spark: SparkSession, path: str, part: str = "train") -> DataFrame:
    """(value): the text of each element of a JSON array, or of the array that ``part`` names in an object of arrays.

    Documents must be valid. Two passes over the file find where blocks begin, for an array one; the driver gets a row for each block, and elements that blocks cut are the only ones
    that are shuffled. A part's key must not hold a closing brace.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found: dict[str, list] = {}
    for r in rows.mapInArrow(_summaries, _SUMMARY).collect():
        found.setdefault(r.file, []).append(r)
    states, kinds = {}, {}
    for file, own in found.items():
        own.sort(key=lambda r: r.block)
        mode, depth = OUT, 0
        kinds[file] = next((r.first for r in own if r.first), "")
        for r in own:
            states[file, r.block] = (mode, depth)
            mode, change = r.summary[2 * mode], r.summary[2 * mode + 1]
            depth += change
    arrays = {f for f, kind in kinds.items() if kind == "["}
    out = None
    for target, key, files in ((1, None, arrays), (2, part.encode(), set(kinds) - arrays)):
        if files:
            own = rows.where(F.col("file").isin(*files)) if arrays and len(files) < len(kinds) else rows
            each = _elements(own, {k: v for k, v in states.items() if k[0] in files}, target, key)
            out = each if out is None else out.unionAll(each)
    return out if out is not None else spark.createDataFrame([], "value string")


def _elements(rows: DataFrame, states: dict, target: int, part: bytes | None) -> DataFrame:
    opened, begun = {}, {}
    last: dict[str, tuple] = {}
    begins: dict[str, int] = {}
    for r in sorted(rows.mapInArrow(_opened(states, target, part), _OPENED).collect(), key=lambda r: (r.file, r.block)):
        opened[r.file, r.block], begun[r.file, r.block] = last.get(r.file), begins.get(r.file)
        if r.key is not None:
            last[r.file] = (bytes(r.key), r.is_array)
        if r.cuts:
            begins[r.file] = r.block
    found = rows.mapInArrow(_pieces(states, opened, begun, target, part), _PIECES)
    whole = found.where("begins is null").select("value")
    order = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    cut = found.where("begins is not null").groupBy("file", "begins").agg(order.alias("pieces"))
    cut = cut.select(F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["value"])).alias("value"))
    text = F.trim(F.regexp_replace(F.col("value").cast("string"), r"^\s+|\s+$", ""))
    return whole.unionAll(cut).select(text.alias("value")).where("value <> ''")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = "["
    for batch in batches:
        for part in slices(batch, "value"):
            out = []
            for value in part.column("value").to_pylist():
                out.append(before + value)
                before = ","
            yield pa.record_batch({"value": pa.array(out, pa.string())})
    yield pa.record_batch({"value": ["[]" if before == "[" else "]"]})


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Write rows as JSON arrays, each task one document of its own, a row a line. Nulls are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_lines, "value string").write.mode("overwrite").text(path)
