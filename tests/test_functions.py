"""Spans, checks, types and entities against Python models and known values."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checks, entity, spans, types

TEXTS = ["", "a1b22c333", "卡号6222 tel 13812345678，+86 13912345678", "🙂12🙂345é6", "no digits", "x" * 50 + "77", "１２３ full width"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*((t,) for t in TEXTS), (None,)], "text string")


@pytest.mark.parametrize("pattern", [r"\d+", r"1[3-9]\d{9}", r"\b\d{2,4}\b", r"[a-z](?=\d)", r"\+86\s*1[3-9]\d{9}"])
def test_spans_are_finditers(texts, pattern):
    for r in texts.select("text", spans.find_spans(F.col("text"), pattern).alias("s")).collect():
        assert [(x.value, x.start, x.end) for x in r.s] == [(m[0], m.start(), m.end()) for m in re.finditer(pattern, r.text or "")]


def test_bad_patterns_raise():
    for bad in ("[a", "x*", "("):
        with pytest.raises(ValueError):
            spans.compiled(bad)


def test_keyword_counts(spark):
    df = spark.createDataFrame([("ababab 手机手机",)], "t string")
    row = df.select(spans.occurrences(F.col("t"), ["ab", "aba", "手机"]).alias("n"), spans.distinct_present(F.col("t"), ["ab", "zz", "手机"]).alias("d"), spans.window(F.col("t"), F.lit(2), F.lit(4), 1).alias("w")).first()
    assert (row.n, row.d, row.w) == (3 + 1 + 2, 2, "baba")


def _truth(spark, check, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.ok for r in df.select("v", F.coalesce(check(F.col("v")), F.lit(False)).alias("ok")).collect()}


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (checks.id_checksum, ["110101199003077571", "440301199003078715", "320106198506051230"], ["110101199003077579", "440301199003078710", "110101199003077578", "1", ""]),
        (checks.mobile_number, ["13812345678", "15912345678", "18612345678", "19912345678"], ["12812345678", "138123456", "138123456789", "1381234567a", ""]),
        (lambda v: checks.luhn(v, 13, 19), ["4532015112830366", "5425233430109903", "378282246310005"], ["4532015112830367", "1234567890123456", "12", ""]),
        (checks.passport, ["E12345678", "G12345678", "P1234567", "S1234567", "D1234567"], ["G1234567", "X12345678", "E1234567"]),
        (checks.email, ["a@b.co", "x.y@z.org"], ["a@b", "@b.c", "a@.b", "a@b.", "a@b@c.d"]),
        (checks.ip, ["1.2.3.4", "255.255.255.255", "::1", "fe80:0:0:0:1:2:3:4"], ["256.1.1.1", "1.2.3", "1::2::3", "999999999999.1.1.1"]),
        (checks.private_ip, ["10.1.1.1", "172.16.0.1", "172.31.9.9", "192.168.1.1", "127.0.0.1"], ["172.32.0.1", "8.8.8.8", "::1", "192.169.1.1"]),
        (checks.social_security_number, ["123-45-6789", "123456789"], ["000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000"]),
        (checks.sequential, ["1234", "987654"], ["123", "1235", "1111", "12a4", ""]),
        (checks.few_digits, ["1111", "1212"], ["123"]),
    ],
)
def test_checks(spark, check, good, bad):
    assert _truth(spark, check, good + bad) == dict.fromkeys(good, True) | dict.fromkeys(bad, False)


def test_cards(spark):
    df = spark.createDataFrame([(v,) for v in ("4532015112830366", "5425233430109903", "378282246310005", "6011000990139424", "3530111333300000", "9999999999999")], "v string")
    got = [tuple(r) for r in df.select(checks.card_type(F.col("v")), checks.masked_card(F.col("v"))).collect()]
    assert [k for k, _ in got] == ["Visa", "MasterCard", "Amex", "Discover", "JCB", "Unknown"] and got[0][1] == "4532********0366"


def test_type_names(spark):
    df = spark.createDataFrame([("drivers_license",), ("IP",), ("email",), ("Foo",), (None,)], "t string")
    got = [tuple(r) for r in df.select(types.normalize_type(F.col("t")), types.display_name(F.col("t"))).collect()]
    assert got == [("DRIVER_LICENSE", "驾驶证号"), ("IP_ADDRESS", "IP地址"), ("EMAIL", "电子邮箱"), ("Foo", "Foo"), (None, None)]
    assert len(types.CANONICAL) == 18 and len(types.ALIASES) == 15 and set(types.DISPLAY) == set(types.CANONICAL)


def test_entity_rules(spark):
    one = lambda v, s, e, c, m="regex": entity.entity("EMAIL", F.lit(v), F.lit(s), F.lit(e), c, m, "r")
    row = spark.range(1).select(entity.problems(one("a", 0, 1, 0.5)).alias("ok"), entity.problems(one("", -1, -1, 1.5, "")).alias("bad")).first()
    assert row.ok == [] and set(row.bad) == {"value", "start_pos", "end_pos", "confidence", "detection_method"}
    kept = spark.range(1).select(entity.with_metadata(entity.entity("T", F.lit("v"), F.lit(0), F.lit(1), 1.0, metadata={"a": F.lit(1), "b": F.lit(2)}), {"b": F.lit(3)}).alias("e")).first()
    assert kept.e.metadata == {"a": "1", "b": "3"}


def test_required_parts_of_patterns(spark):
    cases = {r"[a-z]+@[a-z]+": ("@", False), r"https?://[^\s]+": ("http", False), r"\b(?:[0-9]{1,3}\.){3}\d": (".", True), "a|b1": ("", False), "(?i)abc": ("", False), r"x?\d*(?:ab)?": ("", False), r"[PG]\d{7}": ("", True), r"(?i:ab)c": ("c", False), "[0-9a-f]{4}": ("", False), "E+x": ("E", False)}
    assert {p: spans.required(p) for p in cases} == cases
    texts = ["no", "a@b", "http://x", "1.2.3.4", "G1234567", "", None, "\u0663\u0664 a@"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import re

    for p in (r"[a-z]+@[a-z]+", r"https?://[^\s]+", r"\b(?:[0-9]{1,3}\.){3}\d", r"[PG]\d{7}", r"\d\d"):
        got = [[x.value for x in r.s] for r in df.select(spans.find_spans(F.col("t"), p).alias("s")).collect()]
        assert got == [re.findall(p, t) if t else [] for t in texts] or "(" in p and got == [[m[0] for m in re.finditer(p, t or "")] for t in texts]


def test_many_matches_of_one_text(spark):
    """Positions take time in proportion to the matches; blocks meet at every size."""
    import time

    pattern = r"[a-z]+[0-9]+@"
    for n in (1, spans.SUM_BLOCK - 1, spans.SUM_BLOCK, spans.SUM_BLOCK + 1, 3 * spans.SUM_BLOCK):
        text = "é🙂 " + "; ".join(f"a{k}@" for k in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(spans.find_spans(F.col("t"), pattern).alias("s")).first().s
        assert [tuple(x) for x in got] == [(m[0], *m.span()) for m in re.finditer(pattern, text)]
    took = {}
    for n in (16_000, 64_000):
        df = spark.createDataFrame([(" ".join(f"a{k}@" for k in range(n)),)], "t string").select(F.size(spans.find_spans(F.col("t"), pattern)).alias("n"))
        began = time.time()
        assert df.first().n == n
        took[n] = time.time() - began
    assert took[64_000] < 4 * took[16_000] + 5


def test_running_and_pieces(spark):
    values = [(k * 7919) % 11 for k in range(1500)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(spans.running(F.col("v")).alias("sum"), spans.running(F.col("v"), lambda a, x: F.greatest(a, x), block=7).alias("top")).first()
    assert got.sum == list(itertools.accumulate(values)) and got.top == list(itertools.accumulate(values, max))
    text = "".join(chr(97 + k % 26) if k % 5 else "🙂" for k in range(3 * spans.PIECE + 5))
    cuts = [(0, 0), (0, 1), (0, len(text)), (spans.PIECE - 1, spans.PIECE + 1), (spans.PIECE, 2 * spans.PIECE), (2 * spans.PIECE, 2 * spans.PIECE), (len(text) - 1, len(text)), (5, 3)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    got = df.select("a", "b", spans.let(spans.in_pieces(F.col("t")), lambda p: spans.taken(p, F.col("a"), F.col("b"))).alias("x")).collect()
    assert {(r.a, r.b): r.x for r in got} == {(a, b): text[a:b] for a, b in cuts}
