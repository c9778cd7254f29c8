"""Keywords in texts by one Aho-Corasick automaton, whose cost doesn't depend on their number."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<word: int, start: int, end: int>>"
_HITS = pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(64)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of distinct, non-empty words; a hit gives a word's place among them."""
    if len(set(words)) < len(words) or "" in words:
        raise ValueError("keywords must be distinct and not empty")
    out = ahocorasick.Automaton()
    for k, word in enumerate(words):
        out.add_word(word, k)
    if words:
        out.make_automaton()
    return out


def occurrences(text: str, words: tuple[str, ...]) -> dict[int, list[int]]:
    """Where each word that occurs begins, overlaps included, in order; found in one pass over the text."""
    out: dict[int, list[int]] = {}
    if words:
        for last, k in automaton(words).iter(text):
            out.setdefault(k, []).append(last - len(words[k]) + 1)
    return out


def runs(text: str, of: str) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the longest runs of a character class."""
    found = [m.span() for m in re.finditer(f"{of}+", text)]
    return [a for a, _ in found], [b for _, b in found]


def suffixed(places: list[int], size: int, within: tuple[list[int], list[int]], least: int, most: int) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of ``[class]{least,most}`` and then a word, as a greedy expression takes them.

    ``places`` are where the word, ``size`` characters long, begins; ``within`` are the runs of the class. One pass over the places.
    """
    begins, ends = within
    out, at, k = [], 0, 0
    while k < len(places):
        place = places[k]
        run = bisect_right(begins, place - 1) - 1  # the run of the character before
        start = max(at, place - most, begins[run]) if run >= 0 and ends[run] >= place else place
        if place - start < least:
            k += 1
            continue
        furthest = min(start + most, ends[run])
        while k + 1 < len(places) and places[k + 1] <= furthest:
            k += 1
        at = places[k] + size
        out.append((start, at))
        k += 1
    return out


def keyword_hits(text: Column, words: Iterable[str]) -> Column:
    """Every occurrence of every word, as (place of the word among ``words``, start, end) by end; overlaps included, none for a null text."""
    words = tuple(words)

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append([{"word": k, "start": last - len(words[k]) + 1, "end": last + 1} for last, k in (automaton(words).iter(t) if t and words else ())])
        return pa.array(out, _HITS)

    return F.arrow_udf(find, HIT)(text)
