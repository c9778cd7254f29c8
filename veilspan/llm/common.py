"""Helpers shared by the operators: word boundaries, rolling hashes, table materialisation."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import give_back

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that the vectorised helpers work on at once; it bounds the memory of a task.
CHUNK_BYTES = 1 << 21

_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share.

    Where it is unset, a temporary folder serves if all run in one process (tests, a laptop); on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="veilspan-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, from prefix sums.

    The base is odd, so it has an inverse and a range's hash doesn't depend on where the range
    lies. Symbols are spread by ``mix`` before they enter.
    """

    def __init__(self, base: int):
        self._step = np.uint64(base | 1)
        self._back = np.uint64(pow(base | 1, -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) <= n:
            size = 1 << int(n).bit_length()
            ups, downs = np.full(size + 1, self._step), np.full(size + 1, self._back)
            ups[0] = downs[0] = 1
            with np.errstate(over="ignore"):
                self._up, self._down = np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols))
        sums = np.zeros(len(symbols) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * self._up[: len(symbols)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[ends] - sums[starts]) * self._down[starts]
            return mix(x + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Two independent hash lanes; together they give 128 bits.
LANES = (0x9E6C63D0876A9A47, 0xD1B54A32D192ED03)
_BYTES = [Rolling(x) for x in LANES]
_WORDS = [Rolling(x ^ 0x5851F42D4C957F2C) for x in LANES]
_BYTE_CODES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in LANES]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Words:
    """The words of a run of documents, as arrays over all of them.

    ``start``/``end`` are byte positions in ``buf``; ``doc`` is each word's document within the run;
    ``first`` has, for each document, the index of its first word, and one more entry at the end.
    ``gaps`` tells for each byte whether it divides words.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_GAP):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = ~gaps[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lane: int = 0) -> np.ndarray:
        sums = _BYTES[lane].prefix(_BYTE_CODES[lane][self.buf])
        return _BYTES[lane].ranges(sums, self.start, self.end)

    def heads(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word; 0 for words that are not longer."""
        sums = _BYTES[0].prefix(_BYTE_CODES[0][self.buf])
        long = self.end - self.start > size
        return np.where(long, _BYTES[0].ranges(sums, self.start, np.minimum(self.start + size, self.end)) ^ np.uint64(size), np.uint64(0))

    def sequence(self, lane: int = 0, hashes: np.ndarray | None = None) -> tuple[Rolling, np.ndarray]:
        """Prefix sums over the word hashes, for the hashes of word ranges."""
        return _WORDS[lane], _WORDS[lane].prefix(self.hashes(lane) if hashes is None else hashes)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about ``most`` bytes; null is empty.

    A longer text is a run of its own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]) by doubling; windows that pass the end take what there is."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        np.minimum(out[:-step], out[step:], out=out[:-step]) if step < len(out) else None
        have += step
    return out


#: Bytes of text in a block of documents; a task holds a block's texts together.
BLOCK_BYTES = 8 << 20
_PACKED_ROWS = 4096
_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def block_of(doc_id: Column, otherwise: Column, blocks: int) -> Column:
    """The block of a document: by its id, or by another column where the id is null."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), otherwise.cast("long"))), F.lit(blocks)).cast("int")


def packed_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, by_id: bool = True) -> tuple[DataFrame, int]:
    """(block, piece) rows and the number of blocks: doc_id and text of every row, dealt into blocks by doc_id.

    Rows without an id, and all rows unless ``by_id``, are dealt one by one, so that no number of equal ones makes a large block.

    A piece holds the rows of one batch that belong to a block, compressed together, so that texts which
    must meet other rows are shuffled at about a third of their size. Null texts are packed as empty ones.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in (x.slice(k, _PACKED_ROWS) for x in batches for k in range(0, x.num_rows, _PACKED_ROWS)):
            block = batch.column("block").to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            rows = pa.record_batch([batch.column("doc_id"), batch.column("text").fill_null("")], schema=_TEXTS).take(pa.array(order))
            edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=blocks))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _TEXTS, options=options) as out:
                    out.write_batch(rows.slice(a, b - a))
                yield pa.record_batch([pa.array([int(block[order[a]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "piece"])
        give_back()

    turn = F.monotonically_increasing_id()
    dealt = docs.withColumn("block", block_of(F.col("doc_id"), turn, blocks) if by_id else block_of(turn, turn, blocks))
    return dealt.mapInArrow(run, "block int, piece binary"), blocks


def unpacked(pieces: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The (doc_id, text) batches of a block."""
    for piece in pieces:
        yield from pa.ipc.open_stream(piece.as_buffer())
