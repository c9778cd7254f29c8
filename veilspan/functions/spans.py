"""Regular-expression matches with positions, windows around them, and keyword counts.

Positions are code points, 0-based, the end exclusive.
"""

from __future__ import annotations

import operator
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<value: string, start: int, end: int>"
#: Elements that are summed in one fold.
SUM_BLOCK = 512
#: Characters in a piece of a text.
PIECE = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def compiled(pattern: str) -> str:
    """The pattern with Unicode classes, after a check on the driver; it must not match the empty text."""
    try:
        empty = re.compile(pattern).match("")
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    if empty:
        raise ValueError(f"pattern {pattern!r} matches the empty text")
    return f"(?U){pattern}"


def required(pattern: str) -> tuple[str, bool]:
    """The longest literal that every match of a pattern holds, and whether each holds a digit."""

    def walk(items) -> tuple[str, bool]:
        best, run, digit = "", "", False
        for kind, arg in items:
            if kind is sre.LITERAL:
                run += chr(arg)
                continue
            best, run, inner = max(best, run, key=len), "", None
            if kind is sre.IN:
                digit |= all(x in ((sre.RANGE, (48, 57)), (sre.CATEGORY, sre.CATEGORY_DIGIT)) for x in arg)
            elif kind is sre.SUBPATTERN and not arg[1]:
                inner = walk(arg[3])
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
                inner = walk(arg[2])
            if inner:
                best, digit = max(best, inner[0], key=len), digit | inner[1]
        return max(best, run, key=len), digit

    parsed = parser.parse(pattern)
    return ("", False) if parsed.state.flags & re.IGNORECASE else walk(parsed)


def _possible(text: Column, pattern: str) -> Column:
    """Whether a text holds what every match needs; null for a null text. Most texts have no match, and this costs less than the pattern."""
    literal, digit = required(pattern)
    out = text.rlike(r"\p{Nd}") if digit else None
    if literal:
        out = text.contains(literal) if out is None else out & text.contains(literal)
    return text.isNotNull() if out is None else out


def _folded(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    def step(state: Column, x: Column) -> Column:
        at = merge(state["at"], x)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


def running(values: Column, merge: Callable[[Column, Column], Column] = operator.add, block: int = SUM_BLOCK) -> Column:
    """The sum, or what ``merge`` makes, of a non-empty array of non-negative integers up to each element.

    A fold copies what it has at each step, so the array is taken in blocks, each from what those before it come to.
    """
    zero = F.lit(0)
    in_parts = lambda own: F.transform(F.sequence(F.lit(1), F.size(own), F.lit(block)), lambda k: F.slice(own, k, F.lit(block)))
    begun = lambda parts: F.concat(F.array(zero), _folded(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: merge(a, x))), merge, zero))
    merged = lambda parts, starts: F.flatten(F.transform(parts, lambda p, k: _folded(p, merge, F.get(starts, k))))
    return let(let(values, in_parts), lambda parts: let(begun(parts), lambda starts: merged(parts, starts)))


def placed(text: Column, regex: str, matches: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(value, start, end)`` of each of a pattern's matches: the texts between them give the positions, in time proportional to the matches."""
    steps = F.zip_with(F.split(text, regex, -1), matches, lambda b, m: F.length(b) + F.coalesce(F.length(m), F.lit(0)))
    return let(running(steps), lambda ends: F.transform(matches, lambda m, k: build(m, F.get(ends, k) - F.length(m), F.get(ends, k))))


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as an array of (value, start, end); empty for a null text.

    Texts that cannot match are not searched.
    """
    regex = compiled(pattern)
    empty = F.array().cast(f"array<{SPAN}>")
    span = lambda value, start, end: F.struct(value.alias("value"), start.alias("start"), end.alias("end"))
    found = lambda matches: F.when(F.size(matches) > 0, placed(text, regex, matches, span)).otherwise(empty)
    return F.when(_possible(text, pattern), let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), found)).otherwise(empty)


def in_pieces(text: Column) -> Column:
    """A text cut every ``PIECE`` characters, for many calls of ``taken``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def taken(pieces: Column, start: Column, end: Column) -> Column:
    """text[start : end] of a text in pieces, in time that depends on what is taken and not on where it stands."""
    first = F.floor(start / PIECE).cast("int")
    own = F.slice(pieces, first + 1, F.greatest(F.ceil(end / PIECE).cast("int") - first, F.lit(0)))
    return F.when(end > start, F.substr(F.array_join(own, ""), start - first * PIECE + 1, end - start)).otherwise("")


def spliced(text: Column, spans: Column, literal: Callable[[Column, bool], Column] = lambda piece, _: piece) -> Column:
    """The text with spans (start, end, new), in order and without overlaps, replaced; what lies between goes through ``literal(piece, whether a span follows)``."""

    def joined(own: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(own, k - 1)["end"]).otherwise(0)

        def from_pieces(parts: Column) -> Column:
            each = F.transform(own, lambda x, k: F.concat(literal(taken(parts, before(k), x["start"]), True), x["new"]))
            return F.concat(F.array_join(each, ""), literal(taken(parts, F.element_at(own, -1)["end"], F.length(text)), False))

        return F.when(F.size(own) > 0, let(in_pieces(text), from_pieces)).otherwise(literal(text, False))

    return let(spans, joined)


def window(text: Column, start: Column, end: Column, width: int) -> Column:
    """text[start - width : end + width]."""
    low = F.greatest(start - width, F.lit(0))
    return F.substr(text, low + 1, end + width - low)


def occurrences(text: Column, words: Iterable[str]) -> Column:
    """How often the words occur in a text, each counted without overlaps."""
    out = F.lit(0)
    for word in words:
        out = out + ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")
    return out


def distinct_present(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in a text."""
    out = F.lit(0)
    for word in words:
        out = out + text.contains(word).cast("int")
    return out
