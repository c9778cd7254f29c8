"""Secret scans with a trigram inverted index, in built-in expressions only.

Each rule's regular expression is turned into a Boolean query of trigrams: a disjunction of sets of
trigrams of which one set must occur whole in any text that matches. The index has a posting
(trigram, document) for the trigrams that some rule asks for. Intersecting the postings of a document
by a grouped aggregation gives the rules that it may match; only those run their expression over the text. A rule without
mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import in_pieces, let, placed, running, taken

#: Alternatives of a literal part that a query spells out at most; beyond it the part asks for nothing.
SPELT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java as to Python's parser; ``keep`` judges a match."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The three base kinds come first, in this order.
BASE = (
    Rule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of the class is one match, so the length may be asked for here
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
)
RULES = BASE + MORE

Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x, y in product(a, b)) if len(a) * len(b) <= SPELT else max(a, b, key=lambda q: min(map(len, q)))


def _least(sets: Iterable[frozenset[str]]) -> Query:
    """Without sets that another one of them is part of."""
    sets = set(sets)
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _spell(items) -> tuple[list[str] | None, Query]:
    """All texts that a parsed sequence can match, if few, and its query."""
    texts: list[str] | None = [""]  # endings since the last part that could not be spelt out
    whole, query = True, _ANY

    def flush() -> None:
        nonlocal texts, query, whole
        if texts:
            query = _both(query, _least(map(_grams, texts)))
        texts, whole = [""], False

    for kind, arg in items:
        own: list[str] | None = None
        asks, more = _ANY, False
        if kind is sre.LITERAL:
            own = [chr(arg).lower()]
        elif kind is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            own = sorted({chr(c).lower() for _, c in arg})
        elif kind is sre.SUBPATTERN:
            own, asks = _spell(arg[-1])
        elif kind is sre.BRANCH:
            parts = [_spell(x) for x in arg[1]]
            own = sum((x for x, _ in parts), []) if all(x is not None for x, _ in parts) else None
            asks = _least(frozenset().union(*(q for _, q in parts)))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, part = arg
            inner, inner_asks = _spell(part)
            if inner is not None and low and len(inner) ** low <= SPELT:
                own = ["".join(x) for x in product(inner, repeat=low)]
                more = high != low  # further repeats follow what is spelt out
            elif inner is not None and (low, high) == (0, 1):
                own = ["", *inner]
            asks = inner_asks if low else _ANY
        elif kind is sre.AT:
            own = [""]
        if own is not None and len(texts) * len(own) <= SPELT:
            texts = [a + b for a in texts for b in own]
            if more:
                flush()
        else:
            flush()
            query = _both(query, asks)
    if whole:
        return texts, _least(map(_grams, texts))
    flush()
    return None, query


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which lies whole in the lower-cased text of any match.

    The empty set among them means that the pattern has no mandatory trigram.
    """
    return _spell(parser.parse(pattern))[1]


def _any_of(endings: set[str]) -> str:
    """An expression for any of some texts of one length, by their first characters."""
    if endings == {""}:
        return ""
    firsts = sorted({x[0] for x in endings})
    parts = [re.escape(c) + _any_of({x[1:] for x in endings if x[0] == c}) for c in firsts]
    return f"(?:{'|'.join(parts)})"


def postings(docs: DataFrame, key: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, gram): for every trigram that a rule asks for, by its number, the documents that hold it.

    A text's own trigrams are gone through once: at each place where one of those asked for may begin, it is taken without consuming the text.
    """
    asked = asked_for(rules)
    if not asked:
        return docs.select(key.alias("key"), F.lit(0).alias("gram")).limit(0)
    begins = "".join(re.escape(c) for c in sorted({g[0] for g in asked}))
    own = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=[{begins}])(?=({_any_of(set(asked))}))"), F.lit(1))
    numbers = F.array(*map(F.lit, asked))
    return docs.select(key.alias("key"), F.explode(F.array_distinct(own)).alias("gram")).select("key", (F.array_position(numbers, F.col("gram")).cast("int") - 1).alias("gram"))


def asked_for(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(g for r in rules for g in trigram_query(r.pattern))))


def candidates(docs: DataFrame, key: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, may): for each document the names of the rules whose trigram query its postings satisfy.

    A document's trigrams are held as bits of as many integers as the rules' trigrams need.
    """
    number = {g: k for k, g in enumerate(asked_for(rules))}
    masks = range(-(-len(number) // 62) or 1)
    bit = F.expr("shiftleft(1L, gram % 62)")
    held = postings(docs, key, rules).groupBy("key").agg(*(F.bit_or(F.when(F.expr("gram div 62") == k, bit).otherwise(0)).alias(f"held_{k}") for k in masks))

    def satisfied(query: Query) -> Column:
        out = F.lit(False)
        for grams in query:
            all_held = F.lit(True)
            for k in masks:
                if mask := sum(1 << number[g] % 62 for g in grams if number[g] // 62 == k):
                    all_held &= F.col(f"held_{k}").bitwiseAND(F.lit(mask)) == mask
            out |= all_held
        return out

    may = F.array_compact(F.array(*(F.when(satisfied(trigram_query(r.pattern)), F.lit(r.kind)) for r in rules)))
    return held.select("key", may.alias("may")).where(F.size("may") > 0)


def _spans(matches: str, rule: Rule, rank: int) -> Column:
    """(start, rank, end, kind) of the kept matches, from the matches and the texts between them."""
    build = lambda value, start, end: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), value.alias("value"))
    found = placed(F.col("text"), rule.pattern, F.col(matches), build)
    if rule.keep:
        found = F.filter(found, lambda x: rule.keep(x["value"]))
    typed = "array<struct<start: int, rank: int, end: int, kind: string>>"
    bare = F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "end", "kind")))).cast(typed)
    return F.when(F.size(matches) > 0, bare).otherwise(F.array().cast(typed))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with ``secrets``: (start, rank, end, kind) of every secret, by start and then by rule.

    Positions are code points, the end is exclusive; matches of one rule don't overlap. A null or empty text
    has none. Rows with a null doc_id and repeated rows are scanned like any other. Other columns stay; one named
    secrets is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "secrets")]
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("a"), F.xxhash64("doc_id", "text").alias("b"))
    some = docs.where(F.col("text").isNotNull())
    may = candidates(some.select("doc_id", "text"), key, rules)
    rows = docs.select(F.struct(*kept).alias("row"), "text", key.alias("key")).join(may, "key", "left")
    full = {r.kind for r in rules if frozenset() in trigram_query(r.pattern)}

    def matches(r: Rule) -> Column:
        runs = F.lit(True) if r.kind in full else F.array_contains("may", r.kind)
        return F.when(F.coalesce(runs, F.lit(False)) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    found = rows.select("row", "text", *(matches(r).alias(f"m_{r.kind}") for r in rules))
    spans = F.array_sort(F.concat(*(_spans(f"m_{r.kind}", r, k) for k, r in enumerate(rules))))
    found = found.select("row", "text", spans.alias("secrets"))
    names = [c for c in docs.columns if c != "secrets"]
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names), "secrets")


def as_text(secrets: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = find_secrets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = as_text(F.filter("secrets", lambda x: x["rank"] < len(BASE)))
    return found.select("doc_id", *(number(r.kind) for r in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with each secret's text replaced by ``[kind]``; of overlapping secrets the first is named and all are covered."""

    def rewritten(parts: Column, covered: Column) -> Column:
        """What stands between the secrets, and their names: each from the furthest end so far."""
        before = lambda k: F.when(k > 0, F.get(covered, k - 1)).otherwise(0)
        piece = lambda x, at: F.when(x["start"] >= at, F.concat(taken(parts, at, x["start"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        named = F.transform("secrets", lambda x, k: let(before(k), lambda at: piece(x, at)))
        return F.concat(F.array_join(named, ""), taken(parts, F.element_at(covered, -1), F.length("text")))

    ends = F.transform("secrets", lambda x: x["end"])
    found = find_secrets(docs, rules)
    text = F.when(F.size("secrets") > 0, let(in_pieces(F.col("text")), lambda parts: let(running(ends, lambda a, x: F.greatest(a, x)), lambda covered: rewritten(parts, covered)))).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "secrets"))
