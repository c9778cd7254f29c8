"""Exact token counts at every prefix of a text, by dynamic programming.

A word's encoding ends in some token; what comes before it is the encoding of a shorter prefix. So
the last token of each prefix, found among the vocabulary's entries that end there, gives the count at
the prefix as one more than the count before that token. Which entry is the last token follows from
a local test: a sequence is the encoding of its text if and only if each token and each pair of
neighbours would come out of the merges as it is. Pairs are tested once and kept.

A text's table holds the byte position of each word's end and the exact count up to there and, if asked for, the exact count
of every prefix by characters. Questions about whole words read the former and ``count_at`` the latter; ``truncated``
needs the former only and computes the prefix counts of the one word that crosses the budget.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, tokenizer
from .common import Words, chunks

#: Entries that a task's tables of words, pieces and pairs hold at most before they start afresh.
KEPT = 1_000_000
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SHORT = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


class _Kept(dict):
    """A table that computes what it lacks and starts afresh when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        out = self[key] = self.make(key)
        return out


class PrefixCounter:
    """Token counts of words and of their prefixes under one vocabulary file."""

    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        self.tokenizer = tokenizer(path)
        self.close = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(x.split(" ")) if isinstance(x, str) else tuple(x): k for k, x in enumerate(model["merges"])}
        self.special = [x["content"].encode() for x in file["added_tokens"]]
        self.parts: dict[str, tuple[str, str, int]] = {}
        self.whole = {x for x in model["vocab"] if len(x) == 1 or self.close and len(x) == 1 + len(self.close) and x.endswith(self.close)}
        for (a, b), k in self.ranks.items():
            if a in self.whole and b in self.whole and a + b not in self.parts and a + b in model["vocab"]:
                self.parts[a + b] = a, b, k
                if self._apart(a, b, k):
                    self.whole.add(a + b)
        self.longest = max(map(len, self.whole))
        self.fits = _Kept(lambda pair: self._apart(*pair))
        self.pieces = _Kept(lambda s: self.prefixes(s)[1][-1])
        self.words = _Kept(self._word)
        self.insides = _Kept(lambda word: np.array(self.inside(word.decode()), np.int32))
        self.lowered = _Kept(self.tokenizer.normalizer.normalize_str)

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at a token's left (0) or right (1) edge while it is built, and the merge that ends each."""
        out, until = [(token, float("inf"))], float("inf")
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, until))
        return out

    def _apart(self, left: str, right: str, before: float = float("inf")) -> bool:
        """Whether no merge ranked under ``before`` joins what stands at the tokens' common edge.

        Equal merges apply from left to right, so at a tie the left token's own merge comes first.
        """
        ranks, edge = self.ranks, self._edge(right, 0)
        for a, ends in self._edge(left, 1):
            for b, until in edge:
                k = ranks.get((a, b))
                if k is not None and k < before and k < ends and k <= until:
                    return False
        return True

    def prefixes(self, piece: str, every: bool = False) -> tuple[list[int], list[int]]:
        """Counts at each prefix of a piece in byte symbols: as it runs on, and if the word ended there.

        Unless ``every`` is set, the second has the full piece's count only.
        """
        n, whole, fits, close, longest = len(piece), self.whole, self.fits, self.close, self.longest
        last: list[str] = [""] * (n + 1)
        runs, ends = [0] * (n + 1), [0] * (n + 1)

        def final(i: int, mark: str) -> tuple[str, int]:
            for k in range(max(0, i - longest), i):
                token = piece[k:i] + mark
                if token in whole and (not k or fits[last[k], token]):
                    return token, runs[k] + 1
            raise ValueError("the vocabulary lacks a byte")

        for i in range(1, n + 1):
            if i < n or every or not close:
                last[i], runs[i] = final(i, "")
            if i == n or every:
                ends[i] = final(i, close)[1]
        return runs, ends

    def split(self, word: str) -> list[str]:
        """A word's pieces in byte symbols, as the tokenizer splits before it merges."""
        if word.isascii() and word.isprintable():
            return _ASCII.findall(word.lower())
        t = self.tokenizer
        return [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))]

    def _word(self, word: bytes) -> int:
        if any(x in word for x in self.special):
            return len(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return sum(map(self.pieces.__getitem__, self.split(word.decode())))

    def inside(self, word: str) -> list[int]:
        """The exact count of each prefix of a word: out[k] is that of its first k characters.

        Special strings and spaces beyond ASCII divide a word into parts that are counted alone. A part that isn't in NFC
        is counted anew at each prefix.
        """
        out, start, at = [0], 0, 0
        special = re.compile("|".join(re.escape(x.decode()) for x in self.special) or "(?!)")
        for m in special.finditer(word):
            # a cut inside the special string leaves plain text
            out += self._spaced(word[start : m.end() - 1], out[start])
            out.append(out[m.start()] + 1)
            start = at = m.end()
        return out + self._spaced(word[at:], out[at])

    def _spaced(self, text: str, before: int) -> list[int]:
        out: list[int] = []
        for part in re.split(f"({_SPACES.pattern}+)", text):
            base = out[-1] if out else before
            out += [base] * len(part) if _SPACES.match(part) else [base + x for x in self._part(part)]
        return out

    def _part(self, text: str) -> list[int]:
        count = lambda x: sum(map(self.pieces.__getitem__, self.split(x)))
        if not unicodedata.is_normalized("NFC", text):
            return [count(text[:k]) for k in range(1, len(text) + 1)]
        shown = [self.lowered[x] for x in text]
        low = "".join(shown)
        at, before = [0] * (len(low) + 1), 0
        for piece, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low):
            if low[a:b] in _SHORT:
                ends = [0] + [count(low[a : a + k]) for k in range(1, b - a + 1)]
            else:
                ends = self.prefixes(piece, every=True)[1]
            size = 0
            for k in range(a, b):
                size += len(low[k].encode())
                at[k + 1] = before + ends[size]
            before = at[b]
        return [at[k] for k in np.cumsum([len(x) for x in shown])]


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _every(counter: PrefixCounter, data: bytes, offsets: np.ndarray, w: Words, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's counts begin, and the count of every prefix of each text by characters, the empty one first.

    ``before`` has the count before each word within its text.
    """
    heads = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
    first = heads[offsets] + np.arange(len(offsets))  # a text of n characters has n + 1 counts
    out = np.zeros(int(first[-1]), np.int32)
    if not len(w):
        return first, out
    number: dict[bytes, int] = {}
    own = np.array([number.setdefault(data[x:y], len(number)) for x, y in zip(w.start.tolist(), w.end.tolist(), strict=True)])
    insides = [counter.insides[x][1:] for x in number]
    sizes = np.array([len(x) for x in insides])
    flat, begin = np.concatenate(insides), np.append(0, np.cumsum(sizes)[:-1])
    size, at = sizes[own], heads[w.start] + w.doc + 1  # of the count after each word's first character
    step = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
    out[np.repeat(at, size) + step] = flat[np.repeat(begin[own], size) + step] + np.repeat(before, size)
    # between words the count stays
    known = np.zeros(len(out), bool)
    known[np.repeat(at, size) + step] = True
    known[first[:-1]] = True
    return first, out[np.maximum.accumulate(np.where(known, np.arange(len(out)), 0))]


def _tables(path: str, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path).words.__getitem__
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, data = Words(buf, offsets), buf.tobytes()
                found = [np.fromiter(map(words, data[x:y].split()), np.int64) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                sums = [np.cumsum(x) for x in found]
                first = pa.array(w.first.astype(np.int32))
                ends = pa.ListArray.from_arrays(first, pa.array((w.end - offsets[w.doc]).astype(np.int32)))
                counts = pa.ListArray.from_arrays(first, pa.array(np.concatenate(sums).astype(np.int32)))
                total = [int(x[-1]) if len(x) else 0 for x in sums]
                arrays = [batch.column("doc_id")[a:b], pa.array(np.diff(offsets), pa.int64()), pa.array(total, pa.int64()), ends, counts]
                if every:
                    begin, flat = _every(counter(path), data, offsets, w, np.concatenate(sums) - np.concatenate(found))
                    arrays.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat)))
                yield pa.record_batch(arrays, names=["doc_id", "n_bytes", "n_tokens", "prefix_bytes", "prefix_tokens", "char_tokens"][: len(arrays)])

    return run


def prefix_counts(docs: DataFrame, path: str = VOCABULARY, every: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_bytes, prefix_tokens) of every row and, with ``every``, char_tokens.

    ``prefix_bytes`` has the byte position of each word's end, ``prefix_tokens`` the exact count of the
    text up to there, ``char_tokens`` the exact count of the first 0, 1, 2, ... characters. A null or empty text counts 0 and has
    no words; a null doc_id and repeated rows stay; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, prefix_bytes array<int>, prefix_tokens array<int>" + ", char_tokens array<int>" * every
    return docs.mapInArrow(_tables(path, every), schema)


def words_within(budget: int | Column) -> Column:
    """How many whole words of a row of ``prefix_counts`` fit a budget of tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.size(F.filter("prefix_tokens", lambda x: x <= budget))


def bytes_within(budget: int | Column) -> Column:
    """Length in bytes of the longest run of whole words, from the text's start, within a budget of tokens.

    It is 0 if the first word is over the budget; ``truncated`` also cuts inside words.
    """
    n = words_within(budget)
    return F.when(n > 0, F.element_at("prefix_bytes", n)).otherwise(0)


def count_at(position: int | Column) -> Column:
    """The exact token count of a text's first ``position`` characters, read from char_tokens.

    A position below 0 counts as 0 and one beyond the text as its end; a null position gives null.
    """
    position = F.lit(position) if isinstance(position, int) else position
    return F.element_at("char_tokens", F.greatest(F.lit(0), F.least(position, F.size("char_tokens") - 1)).cast("int") + 1)


def truncated(tables: DataFrame, budget: int | Column, path: str = VOCABULARY) -> DataFrame:
    """Add kept_text, kept_bytes and kept_tokens: each text's longest start within a budget of tokens, cut at any character.

    ``tables`` has the columns of ``prefix_counts`` with text. The start ends with a character of a word. Of the words, only
    the one that crosses the budget is looked at. A null budget gives nulls; a null text has a null start of 0 bytes.
    """
    limit = "__budget"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts, sizes, counts = [], [], []
            for text, most, ends, tokens in zip(*(batch.column(x) for x in ("text", limit, "prefix_bytes", "prefix_tokens")), strict=True):
                if not most.is_valid:
                    for x in (texts, sizes, counts):
                        x.append(None)
                    continue
                data, most = (text.as_py() or "").encode(), most.as_py()
                ends, tokens = ends.values.to_numpy(zero_copy_only=False), tokens.values.to_numpy(zero_copy_only=False)
                k = int(np.searchsorted(tokens, most, "right"))
                size, n = (int(ends[k - 1]), int(tokens[k - 1])) if k else (0, 0)
                if k < len(ends) and n <= most:
                    raw = data[size : int(ends[k])]
                    word = raw.split()[0].decode()
                    inside = np.array(c.inside(word))
                    last = int(np.flatnonzero(inside <= most - n)[-1])
                    if last:
                        size, n = int(ends[k]) - len(word[last:].encode()), n + int(inside[last])
                texts.append(data[:size].decode() if text.is_valid else None)
                sizes.append(size)
                counts.append(n)
            columns = [batch.column(x) for x in batch.schema.names if x != limit]
            names = [x for x in batch.schema.names if x != limit]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*names, "kept_text", "kept_bytes", "kept_tokens"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in tables.schema)
    rows = tables.withColumn(limit, (F.lit(budget) if isinstance(budget, int) else budget).cast("long"))
    return rows.mapInArrow(run, f"{schema}, kept_text string, kept_bytes long, kept_tokens long")


def token_counts(docs: DataFrame, limit: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) from the prefix tables."""
    return prefix_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
