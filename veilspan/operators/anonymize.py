"""Rewriting entities: redaction, masks, hashes, encryption, stand-ins and reversible pseudonyms."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entity import replaced, with_metadata
from ..functions.spans import spliced
from .tables import REVEALED, REVEALED_ELSE

#: A strategy gives the replacement of an entity.
Strategy = Callable[[Column], Column]


def redact(template: str = "[{entity_type}]", generic: str | None = None) -> Strategy:
    """A placeholder with the type's name, or the same text for all."""
    if generic is not None:
        return lambda e: F.lit(generic)
    before, _, after = template.partition("{entity_type}")
    return lambda e: F.concat(F.lit(before), e["entity_type"], F.lit(after))


def mask(char: str = "*", revealed: Mapping[str, tuple[int, int]] = REVEALED, otherwise: tuple[int, int] = REVEALED_ELSE) -> Strategy:
    """Keep some characters at both ends. A value with no more than those is hidden whole."""

    def replacement(e: Column) -> Column:
        v, n = e["value"], F.length(e["value"])

        def kept(first: int, last: int) -> Column:
            return F.when(n <= first + last, F.repeat(F.lit(char), n)).otherwise(F.concat(F.left(v, F.lit(first)), F.repeat(F.lit(char), n - first - last), F.right(v, F.lit(last))))

        out = kept(*otherwise)
        for kind, ends in revealed.items():
            out = F.when(e["entity_type"] == kind, kept(*ends)).otherwise(out)
        return out

    return replacement


def hashed(salt: str, algorithm: str = "sha256", prefix: str = "HASH:", length: int | None = None) -> Strategy:
    """The digest of salt and value. The salt has no default: it is a secret of whoever runs the job."""
    digest = {"sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512), "md5": F.md5}[algorithm]

    def replacement(e: Column) -> Column:
        out = digest(F.concat(F.lit(salt), e["value"]).cast("binary"))
        return F.concat(F.lit(prefix), F.left(out, F.lit(length)) if length else out)

    return replacement


def encrypted(key: str | Column, output: str = "hex", prefix: str = "ENC:AES256:") -> Strategy:
    """AES-GCM with a random IV; ``decrypted`` reverses it. The key has 16, 24 or 32 bytes."""
    form = {"hex": F.hex, "base64": F.base64}[output]
    key = F.lit(key) if isinstance(key, str) else key
    return lambda e: F.concat(F.lit(prefix), form(F.aes_encrypt(e["value"].cast("binary"), key.cast("binary"))))


def decrypted(value: Column, key: str | Column, output: str = "hex", prefix: str = "ENC:AES256:") -> Column:
    """The plain value; null for what is no such cipher text."""
    key = F.lit(key) if isinstance(key, str) else key
    data = F.substr(value, F.lit(len(prefix) + 1), F.length(value))
    data = F.unhex(data) if output == "hex" else F.unbase64(data)
    return F.when(value.startswith(prefix), F.try_aes_decrypt(data, key.cast("binary")).cast("string"))


def synthetic(seed: str = "") -> Strategy:
    """A stand-in of the value's own shape: each digit and ASCII letter becomes another one of its class, fixed by the value and the seed.

    Equal values get equal stand-ins without a shared table; e-mail keeps its domain's form, and separators stay.
    """

    def replacement(e: Column) -> Column:
        v = e["value"]
        bits = F.sha2(F.concat(F.lit(seed), e["entity_type"], v).cast("binary"), 256)

        def char(c: Column, i: Column) -> Column:
            n = F.conv(F.substr(bits, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))
            return F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

        return F.array_join(F.transform(F.split(v, ""), char), "")

    return replacement


class Anonymizer:
    """Strategies by name, which types use which, and the one for the rest (none: those stay as they are)."""

    def __init__(self, strategies: Mapping[str, Strategy], by_type: Mapping[str, str] | None = None, default: str | None = None):
        if default is not None and default not in strategies:
            raise ValueError(f"unknown default strategy {default!r}")
        self.strategies, self.by_type, self.default = dict(strategies), dict(by_type or {}), default

    def strategy(self, entity_type: str) -> str | None:
        """The name of a type's strategy; an unregistered one falls back to the default."""
        name = self.by_type.get(entity_type, self.default)
        return name if name in self.strategies else self.default

    def _chosen(self, e: Column) -> Column:
        """The name of an entity's strategy, null if it has none."""
        out = F.lit(self.default)
        for kind in self.by_type:
            out = F.when(e["entity_type"] == kind, F.lit(self.strategy(kind))).otherwise(out)
        return out

    def replacement(self, e: Column) -> Column:
        """The replacement of an entity, null if it stays."""
        name, out = self._chosen(e), F.lit(None).cast("string")
        for key, strategy in self.strategies.items():
            out = F.when(name == key, strategy(e)).otherwise(out)
        return out

    def text(self, text: Column, entities: Column) -> Column:
        """The text with each entity replaced. Entities must not overlap: resolve them before."""
        pieces = F.transform(entities, lambda e: F.struct(e["start_pos"].alias("start"), e["end_pos"].alias("end"), self.replacement(e).alias("new")))
        return spliced(text, F.array_sort(F.filter(pieces, lambda p: p["new"].isNotNull())))

    def entities(self, entities: Column) -> Column:
        """The entities with their replacements as values, at their original starts; the metadata keep the original."""

        def one(e: Column) -> Column:
            new = self.replacement(e)
            out = replaced(e, value=new, end_pos=(e["start_pos"] + F.length(new)).cast("int"))
            facts = {"original_value": e["value"], "anonymization_strategy": self._chosen(e)}
            return F.when(new.isNull(), e).otherwise(with_metadata(out, facts))

        return F.transform(entities, one)

    def apply(self, rows: DataFrame, text: str = "text", entities: str = "entities", into: str = "anonymized_text") -> DataFrame:
        return rows.withColumn(into, self.text(F.col(text), F.col(entities)))


def pseudonymize(rows: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Add pseudonymized_text with ``[TYPE_n]`` for each distinct value of a type, numbered by first occurrence, and the map back."""
    e = F.array_sort(F.col(entities), lambda a, b: a["start_pos"] - b["start_pos"])
    pair = lambda x: F.struct(x["entity_type"].alias("t"), x["value"].alias("v"))
    distinct = F.array_distinct(F.transform(e, pair))

    def name(p: Column) -> Column:
        same = F.filter(F.col("__distinct"), lambda q: q["t"] == p["t"])
        return F.concat(F.lit("["), p["t"], F.lit("_"), F.array_position(same, p), F.lit("]"))

    rows = rows.withColumn("__distinct", distinct)
    names = F.map_from_entries(F.transform("__distinct", lambda p: F.struct(name(p).alias("k"), p["v"].alias("v"))))
    pieces = F.transform(entities, lambda x: F.struct(x["start_pos"].alias("start"), x["end_pos"].alias("end"), name(pair(x)).alias("new")))
    return rows.withColumn("pseudonymized_text", spliced(F.col(text), F.array_sort(pieces))).withColumn("pseudonyms", names).drop("__distinct")


def restore(text: Column, pseudonyms: Column) -> Column:
    """The original text from a pseudonymised one and its map."""
    return F.aggregate(F.map_entries(pseudonyms), text, lambda t, p: F.replace(t, p["key"], p["value"]))
