"""Pseudonyms that hold for a whole corpus, and stand-ins that a key reverses.

A value has one pseudonym, ``[TYPE_n]``, wherever it occurs; numbers are dense within a type. Brackets of the text that could be taken for
a pseudonym's are doubled, so that every text is restored exactly.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import find_spans, spliced
from ..sources.storage import checkpointed

#: Distinct values in a range that is numbered by one task.
RANGE_ROWS = 1_000_000
_LIKE = r"\w+_[0-9]+\]"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition and their place within it and their type."""
    from pyspark import TaskContext

    part, now, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for kind in batch.column("entity_type").to_pylist():
            now, place = kind, place + 1 if kind == now else 1
            places.append(place)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["entity_type", "value", "part", "place"])


def numbered(values: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(entity_type, value, n) of the distinct values: 1, 2, ... within each type in the order of the values.

    Ranges are sorted and numbered by themselves, and what earlier ranges hold of a type is added; no task sees a whole type. Rows with a null type or value are left out.
    """
    distinct = values.select("entity_type", "value").dropna().distinct()
    distinct = checkpointed(distinct)
    parts = distinct.count() // range_rows + 1
    ranges = distinct.repartitionByRange(parts, "entity_type", "value").sortWithinPartitions("entity_type", "value")
    placed = checkpointed(ranges.mapInArrow(_placed, "entity_type string, value string, part int, place long"))
    sizes = placed.groupBy("entity_type", "part").agg(F.max("place").alias("size"))
    before = Window.partitionBy("entity_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return placed.join(offsets, ["entity_type", "part"]).select("entity_type", "value", (F.col("place") + F.col("offset")).alias("n"))


def pseudonym_table(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """(entity_type, value, pseudonym) of all values of a corpus."""
    each = rows.select(F.explode(entities).alias("e")).select("e.entity_type", "e.value")
    name = F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.col("n"), F.lit("]"))
    return numbered(each).select("entity_type", "value", name.alias("pseudonym"))


def _doubled(piece: Column, followed: bool) -> Column:
    """Brackets before what reads like a pseudonym, or before one, twice; an odd run is then a pseudonym's, an even one isn't."""
    out = F.regexp_replace(piece, rf"(?U)(\[+)({_LIKE})", "$1$1$2")
    return F.regexp_replace(out, r"(\[+)\z", "$1$1") if followed else out


def pseudonymize_corpus(rows: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "text", entities: str = "entities") -> DataFrame:
    """Add pseudonymized_text, with the pseudonyms of a corpus's table. Keys must be unique, and entities resolved.

    Types must be made of word characters. Values outside the table stay.
    """
    each = rows.select(key, F.explode(entities).alias("e")).select(key, F.col("e.start_pos").alias("start"), F.col("e.end_pos").alias("end"), "e.entity_type", "e.value")
    found = each.join(table, ["entity_type", "value"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("pseudonym").alias("new")))).alias("__new"))
    new = spliced(F.col(text), F.coalesce("__new", F.array().cast("array<struct<start: int, end: int, new: string>>")), _doubled)
    return rows.join(found, key, "left").withColumn("pseudonymized_text", new).drop("__new")


def restore_corpus(rows: DataFrame, table: DataFrame, key: str = "doc_id", text: str = "pseudonymized_text", into: str = "restored_text") -> DataFrame:
    """Add the text with every pseudonym of the table replaced by its value; unknown ones stay, doubled brackets are single again. Keys must be unique."""
    spans = find_spans(F.col(text), rf"\[+{_LIKE}")
    each = rows.select(key, F.explode(spans).alias("s")).select(key, "s.*")
    run = F.length("value") - F.length(F.ltrim("value", F.lit("[")))
    each = each.withColumn("run", run).withColumn("name", F.expr("concat('[', substr(value, run + 1))"))
    # an even run has no pseudonym to look up
    each = each.withColumn("asked", F.expr("if(run % 2 = 1, name, concat(name, '#', start))"))
    met = each.join(table.select(F.col("pseudonym").alias("asked"), F.col("value").alias("original")), "asked", "left")
    new = F.when(F.expr("run % 2 = 1"), F.concat(F.expr("repeat('[', (run - 1) div 2)"), F.coalesce("original", "name"))).otherwise(F.expr("concat(repeat('[', run div 2 - 1), name)"))
    found = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", new.alias("new")))).alias("__new"))
    back = spliced(F.col(text), F.coalesce("__new", F.array().cast("array<struct<start: int, end: int, new: string>>")))
    return rows.join(found, key, "left").withColumn(into, back).drop("__new")


# ---- stand-ins that a key reverses --------------------------------------------------

#: First character and number of characters of the classes that a stand-in keeps.
CLASSES = (("0", 10), ("a", 26), ("A", 26), ("一", 20902))
ROUNDS = 10
#: What values of a type look like; a stand-in looks so exactly if its value does.
FORMS = {"PHONE_NUMBER": r"1[3-9][0-9]{9}", "CHINA_PHONE": r"1[3-9][0-9]{9}", "BANK_CARD": r"[1-9][0-9]{15,18}", "CHINA_BANK_CARD": r"[1-9][0-9]{15,18}"}


class Permutation:
    """A keyed permutation of all values of one shape, for each type one of its own: a Feistel network over the characters that have a class.

    In each round one half is shifted, character by character within its class, by a keyed digest of the other half. Where a type has a form, the network is
    applied again until the result has the form if and only if the value does, which makes it a permutation of the values of that form.
    """

    def __init__(self, key: bytes | str, forms: Mapping[str, str] | None = None):
        self.key = key.encode() if isinstance(key, str) else key
        self.forms = {k: re.compile(p) for k, p in (FORMS if forms is None else forms).items()}

    def _shifts(self, kind: str, turn: int, shape: str, half: list[int], n: int) -> list[int]:
        out, count = b"", 0
        said = f"{kind}\0{shape}\0{turn}\0{half}".encode()
        while len(out) < 4 * n:
            out += hmac.new(self.key, said + count.to_bytes(4, "big"), hashlib.sha256).digest()
            count += 1
        return [int.from_bytes(out[4 * k : 4 * k + 4], "big") for k in range(n)]

    def _network(self, kind: str, value: str, back: bool) -> str:
        places, numbers, sizes = [], [], []
        for k, c in enumerate(value):
            for first, size in CLASSES:
                if 0 <= ord(c) - ord(first) < size:
                    places.append(k)
                    numbers.append(ord(c) - ord(first))
                    sizes.append((ord(first), size))
                    break
        shape = "".join(chr(first) for first, _ in sizes)
        middle = (len(numbers) + 1) // 2
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own = range(middle) if turn % 2 == 0 else range(middle, len(numbers))
            other = numbers[middle:] if turn % 2 == 0 else numbers[:middle]
            for k, shift in zip(own, self._shifts(kind, turn, shape, other, len(own)), strict=True):
                numbers[k] = (numbers[k] + (-shift if back else shift)) % sizes[k][1]
        out = list(value)
        for k, n, (first, _) in zip(places, numbers, sizes, strict=True):
            out[k] = chr(first + n)
        return "".join(out)

    def apply(self, kind: str, value: str, back: bool = False) -> str:
        form = self.forms.get(kind)
        formed = bool(form and form.fullmatch(value))
        while True:
            value = self._network(kind, value, back)
            if form is None or bool(form.fullmatch(value)) == formed:
                return value


def _mapped(permutation: Permutation, back: bool) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def run(kinds: pa.Array, values: pa.Array) -> pa.Array:
        known: dict[tuple, str | None] = {}
        for pair in zip(kinds.to_pylist(), values.to_pylist(), strict=True):
            if pair not in known:
                known[pair] = None if None in pair else permutation.apply(*pair, back=back)
        return pa.array([known[p] for p in zip(kinds.to_pylist(), values.to_pylist(), strict=True)], pa.string())

    return run


def stand_in(entity_type: Column, value: Column, key: bytes | str, forms: Mapping[str, str] | None = None) -> Column:
    """A stand-in of the value's shape, another one for each other value of the type; whoever has the key can reverse it."""
    return F.arrow_udf(_mapped(Permutation(key, forms), False), "string")(entity_type, value)


def stood_for(entity_type: Column, stand_in: Column, key: bytes | str, forms: Mapping[str, str] | None = None) -> Column:
    """The value that a stand-in stands for."""
    return F.arrow_udf(_mapped(Permutation(key, forms), True), "string")(entity_type, stand_in)
