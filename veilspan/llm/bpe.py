"""Byte-pair encoding and decoding with a distinct-word table.

The tokenizer never lets a token span white space, so a text's ids are the ids of its words, one after
the other. Encoding therefore works on words and not on texts:

1. Documents are dealt into blocks by a hash; a block's texts travel as compressed columnar pieces.
2. Each block lists its distinct words, and the lists are dealt by a hash of the word. A task that gets
   all lists of its share of words encodes each distinct word of the corpus once.
3. The ids go back to the blocks that listed the word and are joined to the texts by the position of
   each word.

So the distinct-word table is never one table of rows: it lies in parts by word, and a list of words travels as one compressed value.
As rows of (block, word) it takes more disk than the texts themselves. ``decode`` joins ids with the id-to-piece table, whose size is that
of the vocabulary file; ``encode`` with ``back`` does so in the tasks that hold the ids.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, give_back, packed_blocks, unpacked

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A block's distinct words are dealt into a share for every so many blocks, and 16 at least.
BLOCKS_PER_SHARE = 2
_BATCH = 4096


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _listed(pieces: pa.ChunkedArray, shares: int) -> list[list[bytes]]:
    """The distinct words of a block, by share, each in order."""
    words: set[bytes] = set()
    for batch in unpacked(pieces):
        for text in batch.column("text"):
            words.update(text.as_buffer().to_pybytes().split())
    out: list[list[bytes]] = [[] for _ in range(shares)]
    for word in words:
        out[zlib.crc32(word) % shares].append(word)
    return [sorted(x) for x in out]


def _lists(shares: int):
    def run(block: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdCompressor().compress
        lists = [(k, zlib.crc32(joined := b" ".join(x)), squeeze(joined)) for k, x in enumerate(_listed(block.column("piece"), shares)) if x]
        give_back()
        share, check, words = zip(*lists, strict=True) if lists else ((), (), ())
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(lists), pa.int32()), "share": pa.array(share, pa.int32()), "check": pa.array(check, pa.int64()), "words": pa.array(words, pa.binary())})

    return run


def _ids(path: str, words: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    encode = tokenizer(path).encode_batch if words else None  # most tasks that fill in ids need none
    for k in range(0, len(words), _BATCH):
        part = words[k : k + _BATCH]
        out.update(zip(part, (x.ids for x in encode([w.decode() for w in part], add_special_tokens=False)), strict=True))
    return out


def _encode_words(path: str):
    def run(share: pa.Table) -> pa.Table:
        """Every block's list of the words of one share: encode each distinct word once."""
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor().compress
        lists = [expand(x.as_buffer()).split(b" ") for x in share.column("words")]
        ids, out = _ids(path, list(set().union(*lists))), []
        for words in lists:
            mine = [ids[w] for w in words]
            counts = np.fromiter(map(len, mine), np.uint32, len(mine))
            flat = np.fromiter((i for x in mine for i in x), np.uint32, int(counts.sum()))
            out.append(squeeze(counts.tobytes() + flat.tobytes()))
        del ids, lists
        give_back()
        return pa.table({"block": share.column("block"), "share": share.column("share"), "check": share.column("check"), "ids": pa.array(out, pa.binary())})

    return run


def _fill(shares: int, path: str, decoded: bool):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Join the ids of a block's distinct words to its texts by position."""
        expand, ids = zstandard.ZstdDecompressor().decompress, {}
        lists = _listed(texts.column("piece"), shares)
        for share, check, packed in zip(*(found.column(c).to_pylist() for c in ("share", "check")), found.column("ids"), strict=True):
            words = lists[share]
            if zlib.crc32(b" ".join(words)) != check:
                continue
            lists[share], data = [], expand(packed.as_buffer())
            ends = np.cumsum(np.frombuffer(data, np.uint32, len(words)), dtype=np.int64) * 4 + 4 * len(words)
            at = 4 * len(words)
            for word, end in zip(words, ends.tolist(), strict=True):
                ids[word] = data[at:end]
                at = end
        # left over only if rows were dealt to other blocks when a lost task of an unordered input ran again
        ids |= {w: np.array(x, np.uint32).tobytes() for w, x in _ids(path, [w for x in lists for w in x]).items()}
        del lists
        keys, out, back = [], [], []
        for batch in unpacked(texts.column("piece")):
            mine = [b"".join(map(ids.__getitem__, text.as_buffer().to_pybytes().split())) for text in batch.column("text")]
            keys.append(batch.column("doc_id"))
            out.append(pa.array(mine, pa.binary()))
            if decoded:
                back.append(pa.array([_decoded(x, pieces(path)) for x in mine], pa.string()))
        ids.clear()
        give_back()
        columns = {"doc_id": pa.chunked_array(keys, pa.int64()), "ids": pa.chunked_array(out, pa.binary())}
        return pa.table(columns | ({"decoded": pa.chunked_array(back, pa.string())} if decoded else {}))

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, back: bool = False) -> DataFrame:
    """(doc_id, ids): each row's token ids as little-endian unsigned 32-bit integers in a binary column.

    The ids are those that the tokenizers library gives the whole text without added special tokens;
    special tokens' strings inside a text become their ids. A null or empty text has no ids, a null
    doc_id stays, repeated rows stay repeated, other columns are not read. With ``back``, ``decoded`` has what
    ``decode`` makes of the ids, in the task that has them.
    """
    packed, blocks = packed_blocks(docs, block_bytes, by_id=False)
    shares = max(16, blocks // BLOCKS_PER_SHARE)
    lists = packed.groupBy("block").applyInArrow(_lists(shares), "block int, share int, check long, words binary")
    found = lists.groupBy("share").applyInArrow(_encode_words(path), "block int, share int, check long, ids binary")
    schema = "doc_id long, ids binary" + ", decoded string" * back
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_fill(shares, path, back), schema)


def piece_table(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, piece) of a vocabulary file."""
    rows = [(k, piece) for k, piece in enumerate(pieces(path).tolist()) if piece is not None]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


@functools.lru_cache(4)
def pieces(path: str) -> np.ndarray:
    """The id-to-piece table as an array by id; ids without a piece hold None."""
    file = json.load(open(path, encoding="utf-8"))
    known = file["model"]["vocab"] | {x["content"]: x["id"] for x in file["added_tokens"]}
    out = np.full(max(known.values(), default=-1) + 1, None, object)
    for piece, k in known.items():
        out[k] = piece
    return out


def _decoded(ids, table: np.ndarray) -> str:
    x = np.frombuffer(ids, "<u4")
    found = table[x[x < len(table)]].tolist()
    return " ".join([p for p in found if p is not None] if None in found else found)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``: the pieces of ``ids`` joined by a space, as the library's decode without a decoder
    step gives them, special tokens included.

    Each distinct sequence of ids is joined with the id-to-piece table once. Ids outside the vocabulary are left out, as the library
    does. Null ids decode to an empty text. Other columns stay; one named decoded is replaced.
    """
    rows = encoded.drop("decoded").withColumn("__key", F.sha2("ids", 256))
    digits = F.regexp_extract_all(F.hex("ids"), F.lit("[0-9A-F]{8}"), F.lit(0))
    number = F.conv(F.concat(*(F.substr("digits", F.lit(k), F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    some = rows.where(F.octet_length("ids") >= 4).select("__key", "ids").dropDuplicates(["__key"])
    each = some.select("__key", F.posexplode(digits).alias("place", "digits")).select("__key", "place", number.alias("id"))
    named = each.join(F.broadcast(piece_table(encoded.sparkSession, path)), "id")
    parts = named.groupBy("__key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "piece")))["piece"], " ").alias("decoded"))
    return rows.join(parts, "__key", "left").drop("__key").withColumn("decoded", F.coalesce("decoded", F.lit("")))


def encode_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) of every row."""
    return encode(docs, path, back=True)


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
