"""Check digits, plausibility and facts of values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the identity-number checksum.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_DIGITS = "10X98765432"
# Card brands by prefix; the first that fits counts.
CARD_PREFIXES = (
    ("Visa", ("4",)),
    ("MasterCard", ("51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27")),
    ("Amex", ("34", "37")),
    ("Discover", ("6011", "644", "645", "646", "647", "648", "649", "65")),
    ("JCB", ("35",)),
)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def all_digits(value: Column) -> Column:
    return value.rlike(r"^[0-9]+$")


def luhn(value: Column, shortest: int, longest: int) -> Column:
    """Luhn check of a value of digits within the given lengths."""
    fits = all_digits(value) & F.length(value).between(shortest, longest)
    return F.when(fits, F.call_function("luhn_check", value)).otherwise(False)


def id_checksum(value: Column) -> Column:
    """The modulus-11 check of an 18-character identity number."""
    total = sum(((F.substr(value, F.lit(k + 1), F.lit(1)).cast("int") * w) for k, w in enumerate(ID_WEIGHTS)), F.lit(0))
    digit = F.substr(F.lit(ID_DIGITS), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    return F.when(value.rlike(r"^[0-9]{17}[0-9Xx]$"), digit == F.upper(F.substr(value, F.lit(18), F.lit(1)))).otherwise(False)


def mobile_number(value: Column) -> Column:
    return value.rlike(r"^1[3-9][0-9]{9}$")


def without_country_code(value: Column) -> Column:
    digits = digits_only(value)
    return F.when(digits.startswith("86") & (F.length(digits) == 13), F.substr(digits, F.lit(3), F.lit(11))).otherwise(digits)


def passport(value: Column) -> Column:
    return value.rlike(r"^(?:[EG][0-9]{8}|[PSD][0-9]{7})$")


def email(value: Column) -> Column:
    """One @ with something on both sides; a dot in the domain, but not at its ends."""
    parts = F.split(value, "@")
    domain = parts[1]
    return (F.size(parts) == 2) & (F.length(parts[0]) > 0) & domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".")


def ip_kind(value: Column) -> Column:
    return F.when(value.contains(":"), "ipv6").when(value.contains("."), "ipv4").otherwise("unknown")


def ip(value: Column) -> Column:
    octets = F.split(value, r"\.")
    four = (F.size(octets) == 4) & F.forall(octets, lambda x: all_digits(x) & (F.length(x) <= 9) & (x.try_cast("int") <= 255))
    colons = F.size(F.split(value, "::")) - 1
    six = (colons <= 1) & value.rlike("^[0-9a-fA-F:]+$")
    return F.when(value.contains(":"), six).otherwise(four)


def private_ip(value: Column) -> Column:
    octets = F.split(value, r"\.")
    second = octets[1].try_cast("int")
    four = (octets[0] == "10") | ((octets[0] == "172") & second.between(16, 31)) | ((octets[0] == "192") & (octets[1] == "168")) | (octets[0] == "127")
    return F.when(value.contains(":"), False).otherwise(F.coalesce(four, F.lit(False)))


def social_security_number(value: Column) -> Column:
    digits = F.replace(value, F.lit("-"), F.lit(""))
    area = F.substr(digits, F.lit(1), F.lit(3))
    fine = ~area.isin("000", "666") & (area < "900") & (F.substr(digits, F.lit(4), F.lit(2)) != "00") & (F.substr(digits, F.lit(6), F.lit(4)) != "0000")
    return F.when(digits.rlike("^[0-9]{9}$"), fine).otherwise(False)


def card_type(value: Column) -> Column:
    out = F.lit("Unknown")
    for name, prefixes in reversed(CARD_PREFIXES):
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | value.startswith(p)
        out = F.when(fits, name).otherwise(out)
    return out


def masked_card(value: Column) -> Column:
    hidden = F.greatest(F.length(value) - 8, F.lit(0))
    shown = F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), hidden), F.right(value, F.lit(4)))
    return F.when(F.length(value) <= 8, F.repeat(F.lit("*"), F.length(value))).otherwise(shown)


def one_digit(value: Column) -> Column:
    """All characters equal."""
    return F.size(F.array_distinct(F.split(value, ""))) <= 1


def few_digits(value: Column) -> Column:
    """At most two different characters."""
    return F.size(F.array_distinct(F.split(value, ""))) <= 2


def sequential(value: Column) -> Column:
    """Four digits or more, each one above, or each one below, the one before."""
    codes = F.transform(F.split(value, ""), lambda x: x.try_cast("int"))
    n = F.length(value)
    steps = F.zip_with(F.slice(codes, 2, F.greatest(n - 1, F.lit(1))), F.slice(codes, 1, F.greatest(n - 1, F.lit(1))), lambda a, b: a - b)
    return F.when(all_digits(value) & (n >= 4), F.forall(steps, lambda x: x == 1) | F.forall(steps, lambda x: x == -1)).otherwise(False)
