"""Corpus-wide pseudonyms and reversible stand-ins."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.functions.entity import ENTITIES
from veilspan.operators.pseudonyms import Permutation, numbered, pseudonym_table, pseudonymize_corpus, restore_corpus, stand_in, stood_for


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_numbers_are_dense_in_order(spark, size):
    rng = random.Random(size)
    values = [(rng.choice(["A", "B", "é"]), f"v{rng.randrange(40)}") for _ in range(200)] + [(None, "x"), ("A", None)]
    got = sorted((r.entity_type, r.value, r.n) for r in numbered(spark.createDataFrame(values, "entity_type string, value string"), size).collect())
    wanted = []
    for kind in ("A", "B", "é"):
        wanted += [(kind, v, n) for n, v in enumerate(sorted({v for k, v in values if k == kind and v}), 1)]
    assert got == wanted


def test_every_text_comes_back(spark):
    texts = ["Ann met Bo.", "[Ann] [[Bo", "[P_1] Ann[P_1]", "[[[P_2]Bo]", "x[P_[Ann]]", "Ann[Bo_7]", "é🙂[[Ann[[[[Q_9] [[[", "", "[P_12", "[", "AnnBo[" * 400, "no one"]
    rows = []
    for k, t in enumerate(texts):
        found = [("P" if m[0] == "Ann" else "Q", m[0], *m.span(), 0.5, "regex", "r", {}) for m in re.finditer("Ann|Bo", t)]
        rows.append((k, t, random.Random(k).sample(found, len(found))))
    rows.append((99, None, []))
    df = spark.createDataFrame(rows, f"doc_id long, text string, entities {ENTITIES}")
    table = pseudonym_table(df)
    assert sorted(map(tuple, table.collect())) == [("P", "Ann", "[P_1]"), ("Q", "Bo", "[Q_1]")]
    hidden = pseudonymize_corpus(df, table)
    got = restore_corpus(hidden, table).collect()
    assert len(got) == len(rows) and all(r.restored_text == r.text for r in got)
    assert all(not re.search("Ann|Bo(?!_7)", r.pseudonymized_text or "") for r in got)
    assert {r.doc_id: r.pseudonymized_text for r in got}[0] == "[P_1] met [Q_1]."
    said = spark.createDataFrame([(1, "[Q_1] knows [P_1], not [P_12] or P_1")], "doc_id long, pseudonymized_text string")
    assert restore_corpus(said, table).first().restored_text == "Bo knows Ann, not [P_12] or P_1"


def test_spliced(spark):
    text = "".join(chr(97 + k % 26) for k in range(3000)) + "🙂"
    cuts = [(0, 2, "<1>"), (2, 2, "+"), (5, 9, ""), (1020, 1030, "é"), (3000, 3001, "end")]
    df = spark.createDataFrame([(text, cuts)], "t string, s array<struct<start: int, end: int, new: string>>")
    got = df.select(spans.spliced(F.col("t"), F.col("s")).alias("x"), spans.spliced(F.col("t"), F.slice("s", 1, 0)).alias("same")).first()
    assert got.x == "<1>+" + text[2:5] + text[9:1020] + "é" + text[1030:3000] + "end" and got.same == text


@pytest.mark.parametrize("shape", ["0", "00", "a0", "000", "A-0a"])
def test_a_permutation_of_each_shape(shape):
    sets = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "-": "-"}
    values = ["".join(x) for x in itertools.product(*(sets[c] for c in shape))]
    one, two = Permutation("k"), Permutation("other")
    new = [one.apply("T", v) for v in values]
    assert sorted(new) == sorted(values) and [one.apply("T", v, back=True) for v in new] == values
    if len(values) > 10:
        assert new != values and new != [two.apply("T", v) for v in values] and new != [one.apply("U", v) for v in values]


def test_forms_are_kept():
    p = Permutation("k", {"T": "[1-3][0-9]"})
    values = [f"{k:02d}" for k in range(100)]
    new = [p.apply("T", v) for v in values]
    assert sorted(new) == values and [p.apply("T", v, back=True) for v in new] == values
    assert all(bool(re.fullmatch("[1-3][0-9]", a)) == bool(re.fullmatch("[1-3][0-9]", b)) for a, b in zip(values, new, strict=True))
    phone = Permutation("k").apply("PHONE_NUMBER", "13812345678")
    assert re.fullmatch(r"1[3-9][0-9]{9}", phone) and phone != "13812345678"


def test_stand_ins_in_a_table(spark):
    rows = [("EMAIL", f"user{k}.x@mail.example.com") for k in range(500)] + [("PERSON_NAME", "张三"), ("PERSON_NAME", "李四"), (None, "x"), ("EMAIL", None), ("EMAIL", ""), ("EMAIL", "user0.x@mail.example.com")]
    df = spark.createDataFrame(rows, "t string, v string").repartition(3)
    got = df.withColumn("n", stand_in(F.col("t"), F.col("v"), "k")).withColumn("o", stood_for(F.col("t"), F.col("n"), "k")).collect()
    assert all(r.o == (r.v if r.t else None) for r in got)
    full = {(r.t, r.v): r.n for r in got if r.n}
    assert len(set(full.values())) == len(full) == 502 and all(re.fullmatch(r"[a-z]{4}[0-9]+\.[a-z]@[a-z]{4}\.[a-z]{7}\.[a-z]{3}", n) for (t, _), n in full.items() if t == "EMAIL")
