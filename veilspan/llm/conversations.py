"""Repair of conversation structure by A* on the lattice of edits.

A conversation's rows, in order, are kept, given another role or deleted, and empty turns inserted, until roles read
``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant in turn. A node of the lattice is a row's place and what
roles have been written; the search takes the node with the least (cost so far plus heuristic, edits so far). The heuristic sums, over the
rows ahead, the deletions that are mandatory and the least that a truncated row costs, so it never exceeds the true cost and never falls by more than an edit costs.

Rows are sorted over all conversations by ranges, so that a conversation of any length is cut into segments that meet no size limit of a task.
A segment is searched from each state that may come before it to each one after it, and segments join as
matrices of (cost, edits) do under least and plus, some at a time. Nearly all conversations are one segment.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows in a segment, and segments that join at a time.
SEGMENT = 128
JOINED = 32
#: Bytes of rows in a range that a task scans, and what a row counts besides its text.
PART_BYTES = 8 << 20
ROW_BYTES = 64
#: What has been written: nothing, a system turn, a user turn last, an assistant turn last. One may end where the conversation may.
_STATES = 4
_ENDS = (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")
_SPACES = " \t\n\x0b\x0c\r"


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: b(lank), d(uplicate), t(runcated) or none."""
    body = text.strip(_SPACES)
    return "b" if not body else "d" if seen else "" if body[-1] in ".!?" else "t"


def edits_of(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that a row allows in a state."""
    yield "D", DELETE, state
    if fault in ("", "t"):
        extra = TRUNCATED if fault else 0
        if (kept := _NEXT.get((state, initial))) is not None:
            yield "K", extra, kept
        for role in "ua":
            if (to := _NEXT.get((state, role))) is not None:
                yield "R", REROLE + extra, to


def search(rows: list[tuple[str, str]], begin: int, goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """The least (cost, edits) that lead over all rows, (initial, fault) each, from a state to each goal that can be reached.

    Edits at equal cost compare as text. Nodes are closed in the order of cost plus heuristic, then edits.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k][1] in ("b", "d") else min(DELETE, TRUNCATED) if rows[k][1] else 0)
    queue, closed, out = [(ahead[0], "", 0, begin)], set(), {}
    while queue and len(out) < len(goals):
        key, done, k, state = heapq.heappop(queue)
        if (k, state) in closed:
            continue
        closed.add((k, state))
        cost = key - ahead[k]
        if k == n and state in goals:
            out[state] = (cost, done)
        for role in "ua":
            to = _NEXT.get((state, role))
            if to is not None and (k, to) not in closed:
                heapq.heappush(queue, (key + INSERT, done + "I", k, to))
        if k < n:
            for letter, more, to in edits_of(*rows[k], state):
                if (k + 1, to) not in closed:
                    heapq.heappush(queue, (cost + more + ahead[k + 1], done + letter, k + 1, to))
    return out


def matrix(rows: list[tuple[str, str]]) -> list[list]:
    """[from, to, cost, edits] of the least edits between every two states."""
    return [[a, b, *way] for a in range(_STATES) for b, way in search(rows, a, tuple(range(_STATES))).items()]


def joined(left: list[list], right: list[list]) -> list[list]:
    """The matrix of two segments that follow each other."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, m, x, p in left:
        for m2, b, y, q in right:
            if m == m2 and ((a, b) not in best or x + y <= best[a, b][0]):
                way = (x + y, p + q)
                best[a, b] = min(best.get((a, b), way), way)
    return [[a, b, *way] for (a, b), way in best.items()]


class Repair:
    """The turns that edits make of rows, told row by row."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, 0

    def _step(self, initial: str) -> None:
        self.state = _NEXT[self.state, initial]

    def inserted(self) -> Iterator[str]:
        """The turns that are inserted here."""
        while self.edits[self.at : self.at + 1] == "I":
            role = "a" if self.state == 2 else "u"
            self._step(role)
            self.at += 1
            yield f"{_ROLES[role]}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        """What stands before a row, and the row itself unless it is deleted."""
        yield from self.inserted()
        letter, self.at = self.edits[self.at], self.at + 1
        if letter == "K":
            self._step(role[:1])
            yield f"{role}:{text}"
        elif letter == "R":
            to = "a" if self.state == 2 else "u"
            self._step(to)
            yield f"{_ROLES[to]}:{text}"


class _Digest:
    """SHA-256 of lines joined by a newline, in bounded memory."""

    def __init__(self):
        self._sum, self._any = hashlib.sha256(), False

    def add(self, lines: Iterator[str]) -> None:
        for line in lines:
            self._sum.update(("\n" if self._any else "").encode() + line.encode())
            self._any = True

    def hex(self) -> str:
        return self._sum.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 gives it the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    how = (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("how")
    rows = rows.select("*", how).where("how <> 0")
    body = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with copies and whether an earlier row has their role and text, sorted in ranges; equal rows are one with the number of its copies."""
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    merged = merged.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = merged.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    same = merged.alias("m").join(firsts.alias("f"), F.expr("m.conv_id <=> f.conv_id and m.role = f.role and m.digest = f.digest"))
    seen = F.expr("not (first.known <=> (turn is not null) and first.turn <=> turn)")
    rows = same.select("m.conv_id", "m.turn", "m.role", "m.text", "m.copies", seen.alias("seen"))
    keys = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


_COUNTS = ("blank", "duplicate", "truncated")


class _Segment:
    """A run of a conversation's rows: what it counts, how it begins and ends, its least edits."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.lines = conv, [], []
        self.sums = dict.fromkeys((*_COUNTS, "illegal", "turns"), 0)
        self.turns: list[int] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        fault = fault_of(text, seen)
        if fault:
            self.sums[_COUNTS["bdt".index(fault)]] += 1
        if self.rows and self.rows[-1][0] + role[:1] not in _LEGAL:
            self.sums["illegal"] += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.sums["turns"] += 1
            self.turns = [*self.turns[:1], turn]
        self.rows.append((role[:1], fault))
        self.lines.append((role, text))

    def told(self) -> str:
        out = self.sums | {"first": self.rows[0][0], "last": self.rows[-1][0], "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None}
        return json.dumps(out | {"matrix": matrix(self.rows)})

    def solved(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of a whole conversation."""
        cost, edits = min(search(self.rows, 0, _ENDS).values())
        repair, digest = Repair(edits), _Digest()
        for role, text in self.lines:
            digest.add(repair.row(role, text))
        digest.add(repair.inserted())
        return *_figures(self.sums | {"low": min(self.turns, default=None), "high": max(self.turns, default=None)}), cost, edits, digest.hex()


def _figures(x: dict) -> tuple[int, int, int, int, int]:
    gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
    return gaps, *(x[c] for c in _COUNTS), x["illegal"]


def _follow(a: dict, b: dict) -> dict:
    """Two runs that follow each other, as one."""
    out = {c: a[c] + b[c] for c in (*_COUNTS, "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = a["low"] if a["low"] is not None else b["low"], b["high"] if b["high"] is not None else a["high"]
    return out | {"first": a["first"], "last": b["last"], "low": low, "high": high, "matrix": joined(a["matrix"], b["matrix"])}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SCANNED = f"conv_id long, part int, number long, segment string, {_RESULT}"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]


def _table(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _expanded(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(conv_id, turn, role, text, seen) of every copy."""
    for conv, turn, role, text, copies, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen")), strict=True):
        for copy in range(copies):
            yield conv, turn, role, text, seen or copy > 0


def _scanned(most: int) -> Callable:
    """Sorted rows to whole conversations that are solved, and segments of those that are long or may go on in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, []
        now, inner = None, False  # inner: it begins and ends in this partition, in one segment

        def close(last: bool) -> None:
            nonlocal number
            if now is not None and now.rows:
                number += 1
                if inner and not last:
                    out.append((now.conv, part, number, None, *now.solved()))
                else:
                    out.append((now.conv, part, number, now.told(), *[None] * 8))

        for batch in batches:
            for conv, turn, role, text, seen in _expanded(batch):
                if now is None or conv != now.conv:
                    close(False)
                    now, inner = _Segment(conv), now is not None
                elif len(now.rows) >= most:
                    inner = False
                    close(True)
                    now = _Segment(conv)
                now.add(turn, role, text, seen)
                if not inner:
                    now.lines.clear()
            yield _table(out, _SCANNED, _KINDS)
            out.clear()
        close(True)
        yield _table(out, _SCANNED, _KINDS)

    return run


def _some_joined(segments: pa.Table) -> pa.Table:
    rows = sorted(zip(segments.column("place").to_pylist(), segments.column("segment").to_pylist(), strict=True))
    whole = json.loads(rows[0][1])
    for _, x in rows[1:]:
        whole = _follow(whole, json.loads(x))
    return pa.table({"conv_id": segments.column("conv_id")[:1], "place": segments.column("group")[:1], "segment": pa.array([json.dumps(whole)], pa.string())})


def _joined_segments(segments: DataFrame) -> DataFrame:
    """(conv_id, segment): all segments of each conversation as one, joined some at a time."""
    order = Window.partitionBy("conv_id").orderBy("part", "number")
    now = cut(segments.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "segment"))
    longest = now.agg(F.max("place")).first()[0]
    while longest:
        grouped = now.withColumn("group", F.expr(f"place div {JOINED}")).groupBy("conv_id", "group")
        now = grouped.applyInArrow(_some_joined, "conv_id long, place long, segment string")
        now, longest = cut(now), longest // JOINED
    return now.select("conv_id", "segment")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least way from nothing to where a conversation may end."""
    for batch in batches:
        rows = []
        for conv, told in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist(), strict=True):
            x = json.loads(told)
            cost, edits = min((c, e) for a, b, c, e in x["matrix"] if a == 0 and b in _ENDS)
            rows.append((conv, *_figures(x), cost, edits))
        yield _table(rows, _DECIDED, [pa.int64()] * 7 + [pa.string()])


_DECIDED = "conv_id long, " + _RESULT.rpartition(", ")[0]


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired conversations: a row that carries the edits comes before each one's rows."""
    now, repair, digest = None, None, None
    kinds, schema = [pa.int64(), pa.string()], "conv_id long, repaired_sha256 string"

    def close() -> list[tuple]:
        if repair is None:
            return []
        digest.add(repair.inserted())
        return [(now, digest.hex())]

    for batch in batches:
        out = []
        for conv, edits, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text", "copies")), strict=True):
            if edits is not None:
                out += close()
                now, repair, digest = conv, Repair(edits), _Digest()
                continue
            for _ in range(copies):
                digest.add(repair.row(role, text))
        yield _table(out, schema, kinds)
    yield _table(close(), schema, kinds)


def repaired(conversations: DataFrame, damage: bool = True, segment: int = SEGMENT) -> DataFrame:
    """One row for every conv_id, null included: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Faults are of the rows in order of turn, nulls first, then role and text: blank, an earlier row's role and text, no sentence end.
    ``gaps`` counts the turns missing between the least and the largest, ``illegal`` neighbours whose initials are not su, ua or au. ``audit`` has the initials of
    the cheapest edits (Keep, Rerole, Delete, Insert), of equally cheap ones the least in ASCII order; ``repaired_sha256`` is of the lines role:text that they leave. With
    ``damage`` rows are damaged first, see ``damaged``. Null roles and texts are one space, repeated rows are rows of their own, and other columns are not read. A conversation without
    rows after damage has zeros, no edits and the digest of nothing; an empty table gives an empty result.
    """
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = damaged(conversations) if damage else conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    ordered = cut(_ordered(rows, size // PART_BYTES + 1))
    scanned = cut(ordered.mapInArrow(_scanned(segment), _SCANNED))
    names = [x.split()[0] for x in _RESULT.split(", ")]
    done = scanned.where("segment is null").select("conv_id", *names)
    open_ = scanned.where("segment is not null").select("conv_id", "part", "number", "segment")
    decided = cut(_joined_segments(open_).mapInArrow(_decided, _DECIDED))
    # a digest is of one text in order, so a long conversation streams through one task, which holds its edits only
    heads = decided.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("edits"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = ordered.alias("o").join(decided.select("conv_id").alias("d"), F.expr("o.conv_id <=> d.conv_id"), "left_semi")
    body = body.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "turn", "role", "text", F.col("copies").cast("long"))
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    digests = stream.mapInArrow(_written, "conv_id long, repaired_sha256 string")
    long = decided.alias("d").join(digests.alias("w"), F.expr("d.conv_id <=> w.conv_id")).select("d.*", "repaired_sha256")
    found = done.unionByName(long.select("conv_id", *names))
    out = every.alias("e").join(found.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names[:6]]
    return out.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
