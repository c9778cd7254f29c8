"""Pattern recognizers: each turns a text column into an array of entities, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.entity import entity, no_entities
from ..functions.spans import compiled, distinct_present, find_spans
from ..functions.types import literal_map

CONTEXT_WIDTH = 50
DENY_WIDTH = 100
BOOST_PER_WORD = 0.05
MOST_BOOST = 0.15
VALID_BONUS = 0.05
INVALID_FACTOR = 0.7


@dataclass(frozen=True)
class Kind:
    """What a recognizer knows of its values: validity, facts, and whether a valid one gains confidence."""

    valid: Callable[[Column], Column] | None = None
    facts: Callable[[Column, Column], dict[str, Column]] = lambda v, ok: {}
    bonus: bool = False


def _part(v: Column, start: int, n: int) -> Column:
    return F.substr(v, F.lit(start), F.lit(n))


def _card(v: Column) -> Column:
    return F.regexp_replace(v, r"[\s\-]", "")


def _url_facts(v: Column, ok: Column) -> dict[str, Column]:
    part = lambda k: F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    return {"valid": ok, "scheme": F.lower(part(1)), "domain": part(2), "path": F.when(part(3) == "", "/").otherwise(part(3)), "has_query": F.length(part(4)) > 1}


# Passport kinds by their first letter.
PASSPORT_TYPES = {"E": "电子护照", "G": "普通护照", "P": "因私护照", "S": "因公护照", "D": "外交护照"}
UNKNOWN_PASSPORT = "未知类型"

KINDS: dict[str, Kind] = {
    "id_card": Kind(
        checks.id_checksum,
        lambda v, ok: {"checksum_valid": ok, "region_code": _part(v, 1, 6), "birth_date": _part(v, 7, 8), "sequence": _part(v, 15, 3), "checksum": _part(v, 18, 1)},
        bonus=True,
    ),
    "mobile": Kind(
        lambda v: checks.mobile_number(checks.without_country_code(v)),
        lambda v, ok: {"normalized": checks.without_country_code(v), "has_country_code": v.startswith("+86") | v.startswith("86")},
    ),
    "bank_card": Kind(lambda v: checks.luhn(_card(v), 16, 19), lambda v, ok: {"luhn_valid": ok, "normalized": _card(v), "length": F.length(_card(v))}, bonus=True),
    "passport": Kind(
        checks.passport,
        lambda v, ok: {"passport_type": F.coalesce(F.element_at(literal_map(PASSPORT_TYPES), _part(v, 1, 1)), F.lit(UNKNOWN_PASSPORT)), "prefix": _part(v, 1, 1), "number": F.substr(v, F.lit(2), F.length(v))},
    ),
    "email": Kind(
        checks.email,
        lambda v, ok: {"valid": ok, "local_part": F.substring_index(v, "@", 1), "domain": F.split(v, "@")[1], "tld": F.substring_index(v, ".", -1)},
    ),
    "ip": Kind(checks.ip, lambda v, ok: {"valid": ok, "ip_type": checks.ip_kind(v), "is_private": checks.private_ip(v)}),
    "url": Kind(lambda v: v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), _url_facts),
    "credit_card": Kind(
        lambda v: checks.luhn(_card(v), 13, 19),
        lambda v, ok: {"luhn_valid": ok, "normalized": _card(v), "length": F.length(_card(v)), "card_type": checks.card_type(_card(v)), "masked": checks.masked_card(_card(v))},
        bonus=True,
    ),
    "ssn": Kind(
        checks.social_security_number,
        lambda v, ok: (lambda d: {"valid": ok, "area": _part(d, 1, 3), "group": _part(d, 4, 2), "serial": _part(d, 6, 4), "masked": F.concat(F.lit("***-**-"), _part(d, 6, 4))})(F.replace(v, F.lit("-"), F.lit(""))),
    ),
    "pattern": Kind(),
}


@dataclass(frozen=True)
class Recognizer:
    """One entity type's patterns, words that raise confidence, and words that forbid a hit."""

    entity_type: str
    patterns: tuple[str, ...]
    kind: str = "pattern"
    name: str = ""
    base: float = 0.85
    context_words: tuple[str, ...] = ()
    deny_words: tuple[str, ...] = ()
    descriptions: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        for name in ("patterns", "context_words", "deny_words", "descriptions"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if not self.entity_type or not isinstance(self.entity_type, str):
            raise ValueError("entity_type must be a non-empty text")
        if not self.patterns:
            raise ValueError(f"{self.entity_type}: patterns must not be empty")
        if not 0 <= self.base <= 1:
            raise ValueError(f"{self.entity_type}: the base confidence must be within 0 and 1")
        if self.kind not in KINDS:
            raise ValueError(f"{self.entity_type}: unknown kind {self.kind}")
        for k, p in enumerate(self.patterns):
            try:
                compiled(p)
            except ValueError as e:
                raise ValueError(f"{self.entity_type}, pattern {k}: {e}") from e
        if not self.name:
            object.__setattr__(self, "name", f"{self.entity_type}_recognizer")

    def with_config(self, config: Mapping) -> Recognizer:
        return replace(self, **dict(config))

    def confidence(self, valid: Column, boost: Column) -> Column:
        bonus = F.when(valid, VALID_BONUS).otherwise(0.0) if KINDS[self.kind].bonus else F.lit(0.0)
        return F.least(F.lit(1.0), F.lit(self.base) + bonus + boost) * F.when(valid, 1.0).otherwise(INVALID_FACTOR)

    def valid(self, value: Column) -> Column:
        """Whether a value passes the recognizer's own check; true where it has none."""
        check = KINDS[self.kind].valid
        return F.coalesce(check(value), F.lit(False)) if check else F.lit(True)

    def _near(self, text: Column, start: Column, width: int) -> Column:
        low = F.greatest(start - width, F.lit(0))
        return F.lower(F.substr(text, low + 1, start + width - low))

    def boost(self, text: Column, start: Column) -> Column:
        """Confidence for the context words in the window around a match's start."""
        if not self.context_words:
            return F.lit(0.0)
        near = self._near(text, start, CONTEXT_WIDTH)
        return F.least(F.lit(MOST_BOOST), distinct_present(near, dict.fromkeys(w.lower() for w in self.context_words)) * BOOST_PER_WORD)

    def denied(self, text: Column, start: Column) -> Column:
        """Whether a forbidding word lies in the window around a match's start, the match included."""
        if not self.deny_words:
            return F.lit(False)
        near = self._near(text, start, DENY_WIDTH)
        return distinct_present(near, dict.fromkeys(w.lower() for w in self.deny_words)) > 0

    def entities(self, text: Column, find: Callable[[Column, str], Column] = find_spans) -> Column:
        """Every hit of every pattern, in the order of the patterns; hits of two patterns may overlap. ``find`` gives a pattern's matches."""

        def build(s: Column) -> Column:
            ok = self.valid(s["value"])
            facts = KINDS[self.kind].facts(s["value"], ok)
            return entity(self.entity_type, s["value"], s["start"], s["end"], self.confidence(ok, self.boost(text, s["start"])), "regex", self.name, facts)

        def one(pattern: str) -> Column:
            spans = find(text, pattern)
            if self.deny_words:
                spans = F.filter(spans, lambda s: ~self.denied(text, s["start"]))
            return F.transform(spans, build)

        return F.concat(no_entities(), *(one(p) for p in self.patterns))


# The default recognizers' types, patterns and base confidences.
DEFAULTS: tuple[Recognizer, ...] = (
    Recognizer("CHINA_ID_CARD", (r"[1-9]\d{5}(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]",), "id_card", base=0.85),
    Recognizer("CHINA_PHONE", (r"1[3-9]\d{9}",), "mobile", base=0.80),
    Recognizer("CHINA_BANK_CARD", (r"\b[1-9]\d{15,18}\b",), "bank_card", base=0.85),
    Recognizer("CHINA_PASSPORT", (r"E\d{8}", r"[PG]\d{7}"), "passport", base=0.80),
    Recognizer("EMAIL", (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",), "email", base=0.80),
    Recognizer("IP_ADDRESS", (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",), "ip", base=0.85),
    Recognizer("URL", (r"https?://[^\s]+", r"ftp://[^\s]+"), "url", base=0.80),
    Recognizer("CREDIT_CARD", (r"\b[0-9]{13,19}\b", r"\b[0-9]{4}[\s\-][0-9]{4}[\s\-][0-9]{4}[\s\-][0-9]{4,7}\b"), "credit_card", base=0.85),
    Recognizer("US_SSN", (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",), "ssn", base=0.85),
)
# The patterns of the hybrid detector, under canonical names.
HYBRID: tuple[Recognizer, ...] = (
    Recognizer("PHONE_NUMBER", (r"1[3-9]\d{9}",), "mobile"),
    Recognizer("ID_CARD", (r"[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]",), "id_card"),
    Recognizer("BANK_CARD", (r"\d{16,19}",), "bank_card"),
    Recognizer("EMAIL", (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",), "email"),
    Recognizer("IP_ADDRESS", (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",), "ip"),
)
#: Kinds of the types that configuration files name.
KIND_OF_TYPE = {r.entity_type: r.kind for r in DEFAULTS} | {"EMAIL_ADDRESS": "email", "IP_ADDRESS_V4": "ip", "IP_ADDRESS_V6": "ip"}


def from_config(config: Mapping) -> Recognizer:
    """A recognizer from a configuration entry as the YAML files have it; its score and validation keys say nothing."""
    kind = KIND_OF_TYPE.get(config["entity_type"], "pattern")
    return Recognizer(
        config["entity_type"],
        tuple(p["pattern"] for p in config["patterns"]),
        kind,
        config.get("name") or "",
        float(config.get("confidence_base", 0.85)),
        tuple(config.get("context_words") or ()),
        tuple(config.get("deny_lists") or ()),
        tuple(str(p.get("description", "")) for p in config["patterns"]),
    )
