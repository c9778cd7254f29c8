"""Phrases, exact search and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm.conversations import joined, matrix, repaired, search
from veilspan.llm.phrases import SuffixAutomaton, collocations
from veilspan.llm.vafile import Grid, possible, search_exact

from .conftest import CLASHES, as_rows, rows_of

# --- phrases


def occurrences(sequences, depth):
    out = defaultdict(list)
    at = 0
    for words in sequences:
        for end in range(len(words)):
            for d in range(1, depth + 1):
                if end - d + 1 >= 0:
                    out[tuple(words[end - d + 1 : end + 1])].append(at + end)
        at += len(words)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_automaton_has_a_state_for_each_set_of_ends(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(1 + seed) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 12))]
    ids = np.array([w for s in sequences for w in s])
    start = np.array([k == 0 for s in sequences for k in range(len(s))])
    ends = occurrences(sequences, 3)
    auto = SuffixAutomaton(ids, start, 3)
    found = {}
    for d, last, count in auto.phrases():
        for at, n in zip(last.tolist(), count.tolist(), strict=True):
            phrase = tuple(ids[at - d + 1 : at + 1].tolist())
            assert phrase not in found
            found[phrase] = n
    assert found == {p: len(e) for p, e in ends.items()}
    assert len(auto.states) == len({tuple(e) for e in ends.values()})  # states are the distinct sets
    for state in auto.states.tolist():  # a suffix link leads to the longest suffix with another set
        longest = tuple(ids[auto.last[state] - auto.depth[state] + 1 : auto.last[state] + 1].tolist())
        others = [longest[k:] for k in range(1, len(longest)) if ends[longest[k:]] != ends[longest]]
        link = auto.link[state]
        assert (link < 0) == (not others)
        if others:
            assert auto.depth[link] == len(others[0]) and auto.endpos[link] == len(ends[others[0]])


def test_an_automaton_of_nothing():
    assert list(SuffixAutomaton(np.zeros(0, int), np.zeros(0, bool), 3).phrases()) == []


def brute_collocations(rows, least, subsumed, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for d in (1, 2, 3):
                for k in range(len(words) - d + 1):
                    f[lang][tuple(words[k : k + d])] += 1
    out = []
    for lang, own in f.items():
        longer = [(p, c) for p, c in own.items() if len(p) == 3 and c >= least]
        found = []
        for p, a in own.items():
            if len(p) == 1 or a < least or len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * c >= subsumed * a for q, c in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "straße", "x\x1cy", "日本", "a b", "\x00", "z"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b", "; "]) for _ in range(n))
    rows = [(k, say(rng.randint(0, 60)), rng.choice(["en", "en", "de", None, "und", ""]), None) for k in range(80)]
    return rows + [(90, None, "en", None), (91, "", "fr", None), (None, "new york " * 3000, "en", None), (92, " .,;\n ", "xx", None)] + rows[:3] * 2


@pytest.mark.parametrize("size", [200, 6 << 20])
def test_collocations_by_definition(spark, size):
    rows = phrase_rows()
    found = collocations(as_rows(spark, rows).repartition(5), least=5, most=None, shard_bytes=size)
    assert rows_of(found) == brute_collocations(rows, 5, 50, None)
    few = collocations(as_rows(spark, rows), least=5, most=7, shard_bytes=size)
    assert rows_of(few) == brute_collocations(rows, 5, 50, 7)


def test_collocations_of_awkward_rows(spark, awkward, clashing, empty):
    from .conftest import awkward_rows

    expected = brute_collocations(awkward_rows(), 10, 50, 2000)
    assert rows_of(collocations(awkward)) == expected
    assert rows_of(collocations(clashing.withColumn("shard", F.lit(1)))) == expected
    assert collocations(empty).collect() == []
    assert collocations(as_rows(spark, [(1, None, None, None), (2, " \n", "en", None)])).collect() == []


# --- exact search


def whole(v):
    return [int(np.floor(256 * float(x))) if abs(x) < 1e300 else int(x) * 256 for x in v]


def brute_search(rows, k, each=50):
    usable = [(n, i, whole(v)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i % each == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c, strict=False)))), j) for m, j, c in usable if m != n)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>"


def searched(spark, rows, schema=VECTORS, **how):
    return rows_of(search_exact(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, **how))


def vector_rows(seed, n=300, d=6):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.normal(size=d) * 0.3).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]  # copies
    rows += [(0, rows[3][1]), (50, rows[50][1]), (50, rows[50][1])]  # shared ids and repeated rows
    rows += [(2000, [0.0] * d), (2050, [-0.001] * d), (2100, None), (2150, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] + [0.0] * (d - 1)), (2250, [float("inf")] * d), (None, [0.1] * d)]
    return rows + [(2300, [0.5, 0.5]), (2301, []), (2350, [])]  # shorter ones


@pytest.mark.parametrize("how", [{}, {"cells": 2}, {"part_rows": 20, "query_rows": 3}, {"sample": 1, "cells": 200}])
def test_search_by_definition(spark, how):
    rows = vector_rows(1)
    assert searched(spark, rows, **how) == brute_search(rows, 5)


def test_queries_meet_all_files_in_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = vector_rows(8, n=120, d=3)
        assert searched(spark, rows, part_rows=30, query_rows=2) == brute_search(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_search_beyond_what_doubles_hold(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=3) * 10.0 ** rng.integers(0, 12)).tolist()) for k in range(120)]
    rows += [(500, [1e200, 0.0, 1.0]), (501, [-1e200, 3.0, 0.0]), (550, [1.7e308, 1.0, 1.0])]
    assert searched(spark, rows, part_rows=50) == brute_search(rows, 5)


def test_search_of_few_rows_and_other_columns(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(1, [0.5])]) == []
    assert searched(spark, [(50, [0.5])]) == []
    rows = [(50, [0.5]), (3, [0.5]), (2, [0.5])]
    assert searched(spark, rows) == [(50, 1, 2, 16384), (50, 2, 3, 16384)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in [*CLASHES, "query", "cls", "c", "q", "place", "members"]:
        df = df.withColumn(c, F.lit("x"))
    assert rows_of(search_exact(df, F.col("vec_id") % 50 == 0)) == searched(spark, rows)


def test_bounds_hold_and_exclude_only_what_cannot_win():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(size=(200, 8)) * 50), np.floor(rng.normal(size=(9, 8)) * 50)
    grid = Grid(x.min(axis=0), x.max(axis=0), x[:40], cells=7)
    least, most = grid.bounds(grid.cells(x), q)
    scores = q @ x.T
    assert (least <= scores).all() and (scores <= most).all()
    ids = rng.permutation(200)
    for k in range(len(q)):
        best = np.lexsort((ids, -scores[k]))[:4]
        assert set(best) <= set(possible(least[k], most[k], ids, 4))
    assert len(possible(np.zeros(50), np.zeros(50), np.arange(50), 5)) == 5


# --- conversations


def brute_repair(rows):
    """rows: (turn, role, text) in order. The result by recursion over suffixes."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def least(k, state, inserts):
        ways = [(0, "", ())] if k == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for role in "ua":
                if (state, role) in step:
                    c, e, t = least(k, step[state, role], inserts + 1) or (None,) * 3
                    if c is not None:
                        ways.append((c + 5, "I" + e, (f"{ {'u': 'user', 'a': 'assistant'}[role]}:", *t)))
        if k < len(rows):
            _, role, text = rows[k]
            options = [("D", 2, state, ())]
            if faults[k] in ("", "truncated"):
                more = 5 * (faults[k] == "truncated")
                options += [("K", more, step.get((state, role[:1])), (f"{role}:{text}",))]
                options += [("R", 1 + more, step.get((state, to[0])), (f"{to}:{text}",)) for to in ("user", "assistant")]
            for letter, cost, to, line in options:
                if to is not None and (rest := least(k + 1, to, 0)):
                    ways.append((cost + rest[0], letter + rest[1], (*line, *rest[2])))
        return min(ways) if ways else None

    cost, audit, lines = least(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute_conversations(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        own[conv] += [] if how == 0 else [(turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    out = []
    for conv, own_rows in own.items():
        ordered = sorted(own_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out.append((conv, *brute_repair(ordered)))
    return sorted(out, key=repr)


def conversation_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            if turn == 0 and rng.random() < 0.4 or rng.random() < 0.05:
                role = rng.choice(["system", "tool", "", "sys", None, "üser"])
            text = rng.choice(["Yes.", "No!", "Why?", "Go on", " \t", "", None, "日本. ", f"Say {rng.random()}.", f"{rng.random()}…"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("segment", "parts"), [(128, 1), (128, 7), (3, 5)])
def test_repair_by_definition(spark, segment, parts, monkeypatch):
    monkeypatch.setattr("veilspan.llm.conversations.PART_BYTES", 40_000 // parts)
    monkeypatch.setattr("veilspan.llm.conversations.JOINED", 4)
    rows = conversation_rows(1, 60, 9) + [(70, *r[1:]) for r in conversation_rows(2, 1, 1) * 3 + conversation_rows(5, 30, 9)] + [(None, 3, "user", "Hm."), (None, None, None, None), (-4, 0, "assistant", "x")]
    rows += rows[5:9] * 2
    assert rows_of(repaired(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), segment=segment)) == brute_conversations(rows)


def test_repair_of_nothing_and_other_columns(spark):
    assert repaired(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert rows_of(repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONVERSATIONS))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = conversation_rows(3, 12, 6)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for c in [*CLASHES, "how", "copies", "segment", "digest", "seen", "first", "part", "number", "kind", "edits"]:
        df = df.withColumn(c, F.lit("x"))
    assert rows_of(repaired(df)) == brute_conversations(rows)


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (2, 1, "user", "Hi.")]
    found = {r.conv_id: (r.cost, r.audit) for r in repaired(spark.createDataFrame(rows, CONVERSATIONS), damage=False).collect()}
    assert found == {1: (0, "KKK"), 2: (2, "RR")}


@pytest.mark.parametrize("seed", range(8))
def test_segments_join_to_the_whole(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suax"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randint(2, 14))]
    at = rng.randint(1, len(rows) - 1)
    assert sorted(joined(matrix(rows[:at]), matrix(rows[at:]))) == sorted(matrix(rows))
    best = min(search(rows, 0, (0, 3)).values())
    assert min(search(rows, 0, (3,)).values()) >= best


def test_a_long_conversation_is_repaired_in_parts(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["A.", f"{k}?", f"{k}!", f"{k}", ""])) for k in range(5000)]
    found = repaired(spark.createDataFrame(rows, CONVERSATIONS)).first()
    ordered, seen, faults = [], set(), []
    for _, turn, role, text in rows:
        how = zlib.crc32(f"1:{turn}".encode()) % 20
        for _ in range([1, 2][how == 3] if how else 0):
            r, t = "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            faults.append((r[0], "b" if not t.strip() else "d" if (r, t) in seen else "" if t[-1] in ".!?" else "t"))
            seen.add((r, t))
            ordered.append((r, t))
    assert (found.cost, found.audit) == min(search(faults, 0, (0, 3)).values())
    assert len([x for x in found.audit if x != "I"]) == len(ordered)


def test_automaton_memory():
    """A shard's automaton takes a bounded number of bytes for each word."""
    import tracemalloc

    rng = np.random.default_rng(5)
    ids, start = rng.zipf(1.3, 200_000) % 20_000, rng.random(200_000) < 0.1
    tracemalloc.start()
    auto = SuffixAutomaton(ids, start, 3)
    for _ in auto.phrases():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("bytes a word", peak / len(ids))
    assert peak < 120 * len(ids)
