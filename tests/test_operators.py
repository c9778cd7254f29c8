"""Recognizers, refinement, rewriting, evaluation and preparation against plain Python models."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions.entity import ENTITIES, no_entities
from veilspan.operators import anonymize, evaluate, model, prepare, refine, rules
from veilspan.operators.detect import Registry, at_least, batch_statistics, detect, exploded, hybrid_detect, of_types
from veilspan.operators.recognizers import DEFAULTS, Recognizer, from_config
from veilspan.operators.tables import MERGEABLE, PRIORITIES
from veilspan.sources import configs, datasets
from veilspan.streaming.detect import anonymized_stream


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(rows):
    return [(r.doc_id, r.entity_type, r.value, r.start_pos, r.end_pos, round(r.confidence, 6)) for r in rows.orderBy("doc_id", "ord").collect()]


def test_default_detection(spark):
    found = exploded(detect(docs(spark, "身份证 110101199003077571 电话13812345678 邮箱 a.b@mail.org", "ssn 123-45-6789 http://u:p@h.com:8/x?q=1 E12345678", None, "")), "doc_id")
    got = {(i, t): (v, c) for i, t, v, _, _, c in spans(found)}
    assert got[0, "CHINA_ID_CARD"] == ("110101199003077571", 0.9) and got[0, "EMAIL"] == ("a.b@mail.org", 0.8)
    assert got[1, "US_SSN"][1] == 0.85 and got[1, "CHINA_PASSPORT"] == ("E12345678", 0.8)
    url = next(r for r in found.where("entity_type = 'URL'").collect())
    assert url.metadata == {"valid": "true", "scheme": "http", "domain": "u:p@h.com:8", "path": "/x", "has_query": "true"}
    assert {i for i, *_ in spans(found)} == {0, 1}


def test_overlapping_patterns_both_hit(spark):
    phone = Recognizer("P", (r"1[3-9]\d{9}", r"\+86\s*1[3-9]\d{9}"), "mobile")
    assert len(spans(exploded(detect(docs(spark, "联系方式：+86 13912345678"), Registry([phone])), "doc_id"))) == 2


def test_context_denial_and_confidence(spark):
    r = Recognizer("N", (r"\d{4}",), base=0.6, context_words=("Card", "Bank", "pin", "code"), deny_words=("order",))
    rows = exploded(detect(docs(spark, "bank card pin code 1234", "order 1234", "x" * 60 + "bank" + "y" * 46 + "1234", "1234 bank"), Registry([r])), "doc_id")
    assert [(i, c) for i, *_, c in spans(rows)] == [(0, 0.75), (2, 0.65), (3, 0.65)]
    bad = Recognizer("ID", (r"\d{18}",), "id_card", base=0.90)
    assert spans(exploded(detect(docs(spark, "110101199003077578"), Registry([bad])), "doc_id"))[0][-1] == round(0.9 * 0.7, 6)


def test_registry():
    r = Registry()
    assert r.load_all({"EMAIL": {"base": 0.5}}) == 9 and r.load_all() == 0 and len(r) == 9
    assert r.get("EMAIL").base == 0.5 and "URL" in r and r.unregister("URL") and not r.unregister("URL")
    with pytest.raises(ValueError):
        r.register(DEFAULTS[0])
    for bad in ({"entity_type": "", "patterns": ("a",)}, {"entity_type": "X", "patterns": ()}, {"entity_type": "X", "patterns": ("[",)}, {"entity_type": "X", "patterns": ("a",), "base": 2}):
        with pytest.raises(ValueError):
            Recognizer(**bad)
    assert [x.entity_type for x in r.chosen(["EMAIL", "nope", "CHINA_PHONE"])] == ["EMAIL", "CHINA_PHONE"]
    assert r.summary()["recognizers"] == 8 and r.metadata("EMAIL")["n_patterns"] == 1


def random_entities(rng, n, kinds=tuple(PRIORITIES)[:6] + MERGEABLE):
    out = []
    for _ in range(n):
        s = rng.randint(0, 40)
        e = s + rng.randint(1, 9)
        out.append((rng.choice(kinds), "v" * (e - s), s, e, rng.choice([0.5, 0.7, 0.9]), rng.choice(["regex", "llm_finetuned", "rule"]), "r", {}))
    return out


def model_resolve(es):
    weight = {"regex": 1.2, "llm_finetuned": 1.0}
    score = lambda e: e[4] * weight.get(e[5], 1.0) + PRIORITIES.get(e[0], 0) / 100 * 0.5
    out, group, end = [], [], None
    for e in sorted(es, key=lambda e: (e[2], e[3])):
        if group and e[2] >= end:
            out.append(max(group, key=score))
            group = []
        end = max(end, e[3]) if group else e[3]
        group.append(e)
    return out + ([max(group, key=score)] if group else [])


def model_overlap(es):
    left, out = sorted(es, key=lambda e: (e[2], -len(e[1]))), []
    while left:
        head, group, rest = left[0], [left[0]], []
        for e in left[1:]:
            shared = min(head[3], e[3]) - max(head[2], e[2])
            (group if shared > 0 and shared >= 0.3 * min(head[3] - head[2], e[3] - e[2]) else rest).append(e)
        left = rest
        out.append(max(group, key=(lambda e: (len(e[1]), e[4])) if len({e[0] for e in group}) == 1 else (lambda e: e[4])))
    return out


def model_adjacent(es):
    chains = []
    for e in sorted(es, key=lambda e: e[2]):
        last = chains[-1][-1] if chains else None
        if last and last[0] == e[0] and e[0] in MERGEABLE and 0 <= e[2] - last[3] <= 2:
            chains[-1].append(e)
        else:
            chains.append([e])
    return [(c[0][0], "".join(e[1] for e in c), c[0][2], c[-1][3], round(sum(e[4] for e in c) / len(c), 9)) for c in chains]


@pytest.fixture(scope="module")
def random_rows(spark):
    rng = random.Random(5)
    rows = [(k, random_entities(rng, rng.randint(0, 12))) for k in range(150)]
    return rows, spark.createDataFrame(rows, f"doc_id long, entities {ENTITIES}")


def core(e):
    return tuple(e)[:5]


def test_resolve_like_the_sequential_model(random_rows):
    rows, df = random_rows
    got = {r.doc_id: [core(e) for e in r.x] for r in df.select("doc_id", refine.resolve(F.col("entities")).alias("x")).collect()}
    assert got == {k: [core(e) for e in model_resolve(es)] for k, es in rows}
    by_rows = refine.resolve_rows(exploded(df, "doc_id"), "doc_id").orderBy("doc_id", "start_pos").collect()
    flat = [(k, *core(e)) for k, es in rows for e in model_resolve(es)]
    assert [(r.doc_id, r.entity_type, r.value, r.start_pos, r.end_pos, r.confidence) for r in by_rows] == flat


def test_merges_like_the_sequential_models(random_rows):
    rows, df = random_rows
    got = df.select("doc_id", refine.merge_overlapping(F.col("entities")).alias("o"), refine.merge_adjacent(F.col("entities")).alias("a")).collect()
    for r in got:
        es = dict(rows)[r.doc_id]
        assert [core(e) for e in r.o] == [core(e) for e in model_overlap(es)]
        assert [(*core(e)[:4], round(e.confidence, 9)) for e in r.a] == model_adjacent(es)
    by_rows = refine.merge_adjacent_rows(exploded(df, "doc_id"), "doc_id").collect()
    flat = sorted((k, *x) for k, es in rows for x in model_adjacent(es))
    assert sorted((r.doc_id, r.entity_type, r.value, r.start_pos, r.end_pos, round(r.confidence, 9)) for r in by_rows) == flat


def test_context_and_filters(spark):
    phone = Recognizer("PHONE_NUMBER", (r"1[3-9]\d{9}",), base=0.45)
    rows = detect(docs(spark, "手机 13812345678", "订单号 13812345678", "13812345678", "电话 13812345678 编号"), Registry([phone]))
    out = rows.select("doc_id", refine.validate_context(F.col("entities"), F.col("text")).alias("entities"))
    assert [(i, c) for i, *_, c in spans(exploded(out, "doc_id"))] == [(0, 0.55), (2, 0.45), (3, 0.45)]
    kinds = [("EMAIL", "x@example.com"), ("EMAIL", "x@real.org"), ("PHONE_NUMBER", "13456"), ("PHONE_NUMBER", "12345678"), ("PHONE_NUMBER", "13812345678"), ("BANK_CARD", "4532015112830366"), ("BANK_CARD", "4532015112830367"), ("ID_CARD", "110101199003077571"), ("ID_CARD", "110101199003077578"), ("PERSON_NAME", "张三"), ("IP_ADDRESS", "127.0.0.1"), ("IMEI", "123")]
    es = [(k, v, 0, len(v), 0.9, "regex", "r", {}) for k, v in kinds]
    df = spark.createDataFrame([(1, es)], f"doc_id long, entities {ENTITIES}")
    assert [e.value for e in df.select(refine.drop_false_positives(F.col("entities")).alias("x")).first().x] == ["x@real.org", "13812345678", "4532015112830366", "110101199003077571"]


def test_anonymizing(spark):
    found = detect(docs(spark, "打 13812345678 或 a.b@mail.org。", "nothing"))
    found = found.withColumn("entities", refine.resolve(F.col("entities")))
    a = anonymize.Anonymizer({"redact": anonymize.redact(), "hash": anonymize.hashed("s", length=8)}, {"EMAIL": "hash"}, "redact")
    text = [r.anonymized_text for r in a.apply(found).orderBy("doc_id").collect()]
    assert text[0].startswith("打 [CHINA_PHONE] 或 HASH:") and text[1] == "nothing"
    es = found.select(a.entities(F.col("entities")).alias("e"), "doc_id").orderBy("doc_id").first().e
    assert es[0].metadata["original_value"] == "13812345678" and es[0].end_pos == es[0].start_pos + len("[CHINA_PHONE]")
    none = anonymize.Anonymizer({"redact": anonymize.redact()}, {"EMAIL": "redact"})
    assert none.apply(found).orderBy("doc_id").first().anonymized_text == "打 13812345678 或 [EMAIL]。"
    back = anonymize.pseudonymize(found).withColumn("back", anonymize.restore(F.col("pseudonymized_text"), F.col("pseudonyms")))
    assert back.where("back = text").count() == 2 and "[EMAIL_1]" in back.orderBy("doc_id").first().pseudonymized_text
    fake = anonymize.Anonymizer({"s": anonymize.synthetic()}, default="s").apply(found).orderBy("doc_id").first().anonymized_text
    assert fake != "打 13812345678 或 a.b@mail.org。" and len(fake) == len("打 13812345678 或 a.b@mail.org。")
    with pytest.raises(ValueError):
        anonymize.Anonymizer({}, default="missing")


def test_masks(spark):
    values = [("PHONE_NUMBER", "13812345678", "138****5678"), ("EMAIL", "ab@c.de", "ab*****"), ("OTHER", "abcd", "****"), ("OTHER", "abcde", "ab*de")]
    df = spark.createDataFrame([([(k, v, 0, 1, 1.0, "m", "r", {})], w) for k, v, w in values], f"entities {ENTITIES}, wanted string")
    assert all(r.x == r.wanted for r in df.select(anonymize.mask()(F.col("entities")[0]).alias("x"), "wanted").collect())


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (1, "B", "y"), (2, "A", "z")], "sample_id long, entity_type string, value string")
    pred = spark.createDataFrame([(1, "A", "x"), (2, "A", "q"), (2, "C", "c")], "sample_id long, entity_type string, value string")
    r = evaluate.evaluate(pred, gold).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2) and r.precision == pytest.approx(1 / 3) and r.f2 == pytest.approx(1 / 3)
    by = {r.entity_type: r for r in evaluate.evaluate_by_type(pred, gold).collect()}
    assert by["ALL"].tp == 1 and by["A"].support == 2 and by["C"].precision == 0 and by["C"].f1 == 0
    empty = gold.limit(0)
    assert evaluate.evaluate(empty, empty).first().f1 == 0
    assert evaluate.ensemble(pred, gold).count() == 5
    lost = {r.entity_type: (r.total, r.missed) for r in evaluate.missed_by_type(pred, gold, spark.createDataFrame([(1, "t"), (2, "u")], "sample_id long, text string")).collect()}
    assert lost == {"A": (3, 1), "B": (1, 1)}
    lat = evaluate.latency(spark.createDataFrame([(float(x),) for x in range(1, 101)], "x double"), "x").first()
    assert (lat.p50, lat.p95, lat.p99, lat.median) == (51, 96, 100, 50.5)
    log = spark.createDataFrame([(1, "10%|# | 1/10"), (2, " 50%|## | 5/10 [00:01]"), (3, "ok")], "line_no long, value string")
    assert tuple(evaluate.progress(log).first()) == (50, 5, 10, "running")
    assert evaluate.scraped_metrics(spark.createDataFrame([("Precision: 95.5%\nRecall: 80%\nF1: 87%",)], "value string")).first()[1:] == (95.5, 80.0, 87.0)


def test_bio(spark):
    rows = [(list("张三在北京"), ["B-PER", "I-PER", "O", "B-LOC", "I-PER"]), (["a", "b"], ["I-PER", "O"]), ([], []), (["x", "y"], ["B-ORG", "B-GPE"])]
    df = spark.createDataFrame(rows, "tokens array<string>, ner_tags array<string>")
    got = [[(e.type, e.value, e.start, e.end) for e in r.output.entities] for r in prepare.from_bio(df).collect()]
    assert got == [[("PERSON_NAME", "张三", 0, 2), ("ADDRESS", "北京", 3, 5)], [("ORGANIZATION", "x", 0, 1), ("ADDRESS", "y", 1, 2)]]
    numbers = spark.createDataFrame([(["a", "b"], [1, 2])], "tokens array<string>, ner_tags array<int>")
    assert prepare.from_bio(numbers).first().output.entities[0].value == "ab"


def test_masked_corpus(spark):
    df = spark.createDataFrame([("Ann of Acme", {"FIRSTNAME_1": "Ann", "COMPANY_1": "Acme", "AGE": "9"}), ("none", {"AGE": "1"})], "source_text string, privacy_mask map<string,string>")
    got = prepare.from_masks(df).collect()
    assert [sorted((e.type, e.start) for e in r.output.entities) for r in got] == [[("ORGANIZATION", 7), ("PERSON_NAME", 0)]]
    df = spark.createDataFrame([("Ann", [("Ann", 0, 3, "FIRSTNAME")])], "source_text string, privacy_mask array<struct<value:string,start:long,end:long,label:string>>")
    assert prepare.from_masks(df).first().output.entities[0].type == "PERSON_NAME"


def test_split_is_exact(spark):
    for n in (0, 1, 10, 997):
        counts = dict(prepare.split(spark.range(n), "id").groupBy("split").count().collect())
        assert counts == {k: v for k, v in {"train": int(n * 0.8), "validation": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}.items() if v}


def test_generated_values_are_valid(spark):
    from veilspan.functions import checks

    rows = prepare.generate(spark, dict.fromkeys(prepare.TEMPLATES, 20), mixed=0.5)
    flat = rows.select("input", F.inline("output.entities"))
    assert flat.where(F.expr("substr(input, start + 1, end - start) <> value")).count() == 0
    assert flat.where("type = 'ID_CARD'").where(~checks.id_checksum(F.col("value"))).count() == 0
    assert flat.where("type = 'BANK_CARD'").where(~checks.luhn(F.col("value"), 16, 19)).count() == 0
    code = lambda v: sum(prepare.CREDIT_CODE.index(c) * 3**k for k, c in enumerate(v[:17])) + prepare.CREDIT_CODE.index(v[17])
    assert all(code(r.value) % 31 == 0 for r in flat.where("type = 'TAX_ID'").collect())
    assert flat.where("type = 'IPV6_ADDRESS' and not rlike(value, '^([0-9a-f]{4}:){7}[0-9a-f]{4}$')").count() == 0
    assert flat.where("type = 'HK_MACAU_PASS' and not rlike(value, '^[CH][0-9]{8}$')").count() == 0
    assert rows.count() == 20 * len(prepare.TEMPLATES) and "<|im_start|>assistant" in prepare.chat(rows).first().chat


def test_normalising_and_consistency(spark):
    df = spark.createDataFrame([([("IP", "1.1.1.1", 0, 7), ("EMAIL", "a", 0, 1)],), (None,)], "entities array<struct<type:string,value:string,start:int,end:int>>")
    assert prepare.normalized_types(df).first().changed == 1
    assert tuple(prepare.consistency(df).first()) == (2, 1, 1, 1)
    assert {(r.type, r.normalized) for r in prepare.type_changes(df).collect()} == {("IP", "IP_ADDRESS"), ("EMAIL", "EMAIL")}


@pytest.mark.parametrize(
    ("response", "found"),
    [('{"a": 1}', {"a": 1}), ('<think>{"no": 1}</think> so {"a": "}"} tail', {"a": "}"}), ('x {"a": {"b": "\\"{"}} y', {"a": {"b": '"{'}}), ('{"a": ', None), ("none", None), (None, None), ("{bad}", None)],
)
def test_first_object(response, found):
    got = model.first_object(response)
    assert (got and json.loads(got)) == found


class Fake:
    def generate(self, prompt, system=None, temperature=0.0, max_tokens=0):
        if "boom" in prompt:
            raise RuntimeError
        return '<think>x</think>{"entities": [{"type": "PERSON_NAME", "value": "Ann"}, {"type": "EMAIL", "value": "z"}, {"value": "no"}, {"type": "PERSON_NAME", "value": "absent"}]}'


def test_model_detection(spark):
    rows = docs(spark, "hi Ann", "boom Ann", " ", None)
    ask = lambda d: model.model_detect(d, Fake, "Find in {text} {{json}}")
    got = {r.doc_id: [(e.entity_type, e.value, e.start_pos) for e in r.entities] for r in hybrid_detect(rows, "deep", ask).collect()}
    assert got == {0: [("PERSON_NAME", "Ann", 3)], 1: [], 2: [], 3: []}
    assert hybrid_detect(rows, "fast", ask).columns == hybrid_detect(rows, "deep").columns
    assert spark.range(1).select(model.lenient_json(F.lit('a {"x": {}} b'))).first()[0] == '{"x": {}}'


class Sleepy:
    def generate(self, prompt, system=None, temperature=0.0, max_tokens=0):
        import time

        time.sleep(30 if "hang" in prompt else 0)
        if "boom" in prompt:
            raise RuntimeError
        return prompt.upper()


def test_a_hung_call_loses_its_row_only(spark):
    import time

    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "hang", "b", "boom", None, "c"])], "id long, prompt string").coalesce(1)
    began = time.time()
    got = {r.id: r.response for r in model.ask(rows, Sleepy, timeout=1.0).collect()}
    assert got == {0: "A", 1: None, 2: "B", 3: None, 4: None, 5: "C"} and time.time() - began < 20
    assert [r.response for r in model.ask(rows.where("id in (0, 3)"), Sleepy).orderBy("id").collect()] == ["A", None]


def test_profile(spark):
    from veilspan.operators.detect import profile

    rows = docs(spark, "a@b.com and c@d.org", "13812345678", None)
    got = profile(rows, entity_types=["EMAIL", "CHINA_PHONE", "URL"])
    assert [(k, v["total_calls"], v["total_hits"]) for k, v in got.items()] == [("EMAIL", 3, 2), ("CHINA_PHONE", 3, 1), ("URL", 3, 0)]
    assert all(v["total_time"] >= 0 and v["avg_time"] == v["total_time"] / 3 for v in got.values())


def test_hazards_are_told_before_the_job():
    from veilspan.operators.isolation import hazards
    from veilspan.operators.recognizers import HYBRID

    assert not any(hazards(p) for r in (*DEFAULTS, *HYBRID) for p in r.patterns)
    assert [bool(hazards(p)) for p in (r"(a+)+b", r"(?:a|b)*c", r"(?:(?:x{2,5}){3})+", r"(a)\1", r"(?:ab)+c+", r"(?:a{1,2000}b)*", r"(?=(a+)+)b", r"[ab]+(?:c|d)?")] == [True, True, False, True, False, True, True, False]


def test_a_hostile_pattern_costs_its_own_hits(spark):
    import time

    from veilspan.operators.isolation import detect_isolated

    registry = Registry([Recognizer("BAD", (r"(?:a|aa)+b", r"c[0-9]")), *DEFAULTS])
    rows = docs(spark, "aab mail x@y.com", "a" * 60 + " b c1 x@y.com", None, "", "c2")
    began = time.time()
    got = {r.doc_id: ([(e.entity_type, e.value) for e in r.entities], r.quarantined) for r in detect_isolated(rows, registry, budget=0.3).collect()}
    assert time.time() - began < 30
    assert got == {0: ([("BAD", "aab"), ("EMAIL", "x@y.com")], []), 1: ([("BAD", "c1"), ("EMAIL", "x@y.com")], ["BAD"]), 2: ([], []), 3: ([], []), 4: ([("BAD", "c2")], [])}
    same = detect_isolated(rows, Registry.default()).collect()
    assert [r.entities for r in same] == [r.entities for r in detect(rows, Registry.default()).collect()] and not any(r.quarantined for r in same)


def test_keyword_heuristics_are_the_expressions():
    """One automaton gives what an expression for each word gives."""
    import random

    from veilspan.functions import keywords
    from veilspan.operators import rules
    from veilspan.operators.tables import ADDRESS_WORDS, ORGANIZATION_WORDS, SURNAMES

    def plain(text):
        out = []
        for m in re.finditer(f"[{SURNAMES}][{rules.CJK}]{{1,3}}", text):
            if text[m.start() - 1 : m.start()] not in ("的", "之") and text[m.end() : m.end() + 1] not in ("的", "之"):
                out.append(("PERSON_NAME", *m.span()))
        for w in ADDRESS_WORDS:
            for m in re.finditer(f"[{rules.CJK}\\d]{{2,20}}{w}", text):
                if not (w == "号" and m.end() < len(text) and re.search("电话|手机|证件|身份|证号|卡号", m[0])):
                    out.append(("ADDRESS", *m.span()))
        for w in ORGANIZATION_WORDS:
            out += [("ORGANIZATION", *m.span()) for m in re.finditer(f"[{rules.CJK}\\w]{{2,30}}{w}", text) if 3 <= len(m[0]) <= 30]
        return out

    rng = random.Random(5)
    parts = [*ADDRESS_WORDS, *ORGANIZATION_WORDS, *SURNAMES[:6], "的", "之", "电话", "证号", "北京", "小", "7", "２", "a", "_", " ", "，", "🙂", "\n"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert rules.heuristic_spans(text) == plain(text), text
    for _ in range(500):
        text = "".join(rng.choice("ab-") for _ in range(30))
        word = rng.choice(["a", "ab", "bb", "-a"])
        places = [k for k in range(len(text)) if text.startswith(word, k)]
        assert keywords.suffixed(places, len(word), keywords.runs(text, "[ab]"), 1, 4) == [m.span() for m in re.finditer(f"[ab]{{1,4}}{word}", text)], (text, word)


def test_keyword_hits(spark):
    from veilspan.functions.keywords import keyword_hits

    words = ["he", "she", "hers", "🙂é", "x"]
    rows = spark.createDataFrame([("ushers 🙂é🙂éx",), (None,), ("",)], "t string")
    got = [[tuple(h) for h in r.h] for r in rows.select(keyword_hits(F.col("t"), words).alias("h")).collect()]
    assert got[1:] == [[], []]
    assert sorted(got[0]) == sorted((k, a, a + len(w)) for k, w in enumerate(words) for a in range(14) if "ushers 🙂é🙂éx".startswith(w, a))
    with pytest.raises(ValueError):
        from veilspan.functions.keywords import automaton

        automaton(("a", "a"))


class Slow:
    opened = 0

    def generate(self, prompt, system=None, temperature=0.0, max_tokens=0):
        import time

        time.sleep(30 if "hang" in prompt else 0.3)
        if "boom" in prompt:
            raise RuntimeError
        return f"{prompt}!"


def test_calls_in_flight(spark):
    """Forty calls of 0.3 s at eight at a time take about 1.5 s, in order, also across batches; hung and failed ones lose their rows only."""
    import time

    model.ask(spark.range(1).selectExpr("'x' prompt"), Slow).collect()  # the worker starts
    prompts = [f"p{k}" for k in range(40)]
    prompts[7], prompts[20], prompts[33] = "boom", None, "hang"
    rows = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        began = time.time()
        got = [(r.id, r.response) for r in model.ask(rows, Slow, width=8, timeout=3.0).collect()]
        took = time.time() - began
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(k, None if p in ("boom", "hang", None) else f"{p}!") for k, p in enumerate(prompts)]
    assert 1.4 < took < 9
    assert [r.response for r in model.ask(rows.where("id < 3"), Slow, width=2).collect()] == ["p0!", "p1!", "p2!"]


class Counted:
    def __init__(self):
        import tempfile

        self.log = f"{tempfile.gettempdir()}/veilspan-asked"

    def generate(self, prompt, system=None, temperature=0.0, max_tokens=0):
        with open(self.log, "a") as f:
            f.write(prompt + "\n")
        return None if prompt == "c" else prompt.upper()


def test_equal_prompts_are_asked_once(spark):
    import os

    log = Counted().log
    if os.path.exists(log):
        os.remove(log)
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k % 4 else None, "old") for k in range(60)], "id long, prompt string, response string")
    got = {r.id: r.response for r in model.ask_once(rows, Counted, width=3, tasks=2).collect()}
    assert got == {k: {"a": "A", "b": "B", "c": None}["abc"[k % 3]] if k % 4 else None for k in range(60)}
    assert sorted(open(log).read().split()) == ["a", "b", "c"]
    os.remove(log)
    texts = docs(spark, "hi Ann", "hi Ann", "boom Ann", " ", None)
    found = model.model_detect(texts, Fake, "Find in {text} {{json}}", once=True, width=4)
    assert {r.doc_id: [e.value for e in r.model_entities] for r in found.collect()} == {0: ["Ann"], 1: ["Ann"], 2: [], 3: [], 4: []}


def test_answers_of_a_tuned_model(spark):
    cases = [
        ('{"entities": [{"value": "Ann"}]}', [("UNKNOWN", "Ann", 3, 6, 0.85)]),
        ('{"entities": [{"type": "P", "value": "Ann", "start_pos": 0, "end_pos": 2, "confidence": 0.9}]}', [("P", "Ann", 0, 2, 0.9)]),
        ('{"entities": [{"type": "P", "value": "Bob"}, {"type": "P", "value": "Ann"}]}', [("P", "Ann", 3, 6, 0.85)]),
        ('{"entities": [{"type": "P", "value": "Ann"}, {"type": "P"}]}', []),  # an empty value is unsound
        ('{"entities": [{"type": "P", "value": "Ann", "confidence": 2.0}, {"type": "P", "value": "Ann"}]}', []),
        ('{"entities": ["Ann"]}', []),
        ('{"entities": [{"type": "P", "value": "Ann"}]} tail', []),
        ("{}", []),
        ("no", []),
        (None, []),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "id long, answer string").withColumn("json", model.whole_object("answer"))
    got = {r.id: [(e.entity_type, e.value, e.start_pos, e.end_pos, e.confidence) for e in r.e] for r in df.select("id", model.tuned_entities(F.lit("hi Ann"), F.col("json")).alias("e")).collect()}
    assert got == {k: wanted for k, (_, wanted) in enumerate(cases)}
    marked = spark.createDataFrame([('so {"entities": []} <|im_end|> x',), ('{"entities": [1',), ("none",)], "a string").select(model.marked_json(F.col("a")).alias("m"))
    assert [r.m for r in marked.collect()] == ['{"entities": []}', '{"entities": [1', None]


def test_detector_information(spark):
    from veilspan.operators.detect import CallStatistics, detector_info, supported_types

    assert supported_types()["llm"] == [] and len(supported_types(True)["all"]) == 8
    assert detector_info("deep") == {"mode": "auto", "llm_enabled": False, "regex_types": supported_types()["regex"], "llm_types": [], "total_types": 5}
    with pytest.warns(UserWarning):
        hybrid_detect(docs(spark, "x"), "deep")
    calls = CallStatistics(Registry.default())
    assert calls.detect(docs(spark, "13812345678", "a@b.org c@d.org", "x"), entity_types=["EMAIL", "CHINA_PHONE"]).count() == 3
    calls.detect(docs(spark, "e@f.org"), entity_types=["EMAIL"]).collect()
    assert calls.get()["EMAIL"] == {"total_calls": 4, "total_hits": 3} and calls.get()["CHINA_PHONE"] == {"total_calls": 3, "total_hits": 1} and calls.get()["URL"]["total_calls"] == 0
    calls.reset()
    assert calls.get()["EMAIL"]["total_calls"] == 0


def test_latency_by_definition(spark):
    """Ties, one very common value, small groups, nulls and no groups at all."""
    rng = random.Random(3)
    rows = [(g, rng.choice([5.0, rng.random() * 100])) for g in ("a", "b") for _ in range(3001)] + [("c", 7.0), ("d", 1.0), ("d", 2.0), (None, 3.0), ("a", None)]

    def wanted(xs):
        xs = sorted(xs)
        n = len(xs)
        return (n, xs[0], xs[-1], (xs[(n - 1) // 2] + xs[n // 2]) / 2, xs[int(n * 0.5)], xs[int(n * 0.95)], xs[int(n * 0.99)])

    df = spark.createDataFrame(rows, "g string, x double")
    cols = ("n", "min", "max", "median", "p50", "p95", "p99")
    got = {r.g: tuple(r[c] for c in cols) for r in evaluate.latency(df, "x", "g").collect()}
    assert got == {g: wanted([x for h, x in rows if h == g and x is not None]) for g in ("a", "b", "c", "d", None)}
    assert tuple(evaluate.latency(df, "x").select(*cols).first()) == wanted([x for _, x in rows if x is not None])
    assert evaluate.latency(df.limit(0), "x", "g").count() == 0


def test_first_rows(spark):
    values = [random.Random(4).choice([7, k]) for k in range(2000)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "k int")
    in_order = sorted(values, key=lambda v: (v is not None, v or 0))
    for n in (0, 1, 3, 900, 1500, 2002):
        assert sorted((r.k for r in prepare.first_rows(df, "k", n).collect()), key=lambda v: (v is not None, v or 0)) == in_order[:n]
    assert prepare.first_rows(df.limit(0), "k", 0).count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "u", "hi"), (1, 1, "a", "Ann here"), (2, 0, "u", None)], "conv_id long, turn long, role string, text string")
    r = model.conversation_text(turns).orderBy("conv_id").first()
    assert r.text == "u: hi\na: Ann here\n" and [(t.turn, t.start) for t in r.turns] == [(0, 0), (1, 6)]


def test_rules(spark):
    rows = docs(spark, "联系人张伟，住址北京市海淀区中关村大街27号院，华东科技有限公司", "邮编 100080", "号码 100080", "京A12345", "的王芳 1111111111111")
    each = exploded(rows.select("doc_id", rules.rule_entities(F.col("text")).alias("entities")), "doc_id")
    got = {(r.doc_id, r.entity_type) for r in each.collect()}
    assert {(0, "PERSON_NAME"), (0, "ADDRESS"), (0, "ORGANIZATION"), (1, "POSTAL_CODE"), (3, "VEHICLE_PLATE")} <= got
    assert (2, "POSTAL_CODE") not in got and (4, "PERSON_NAME") not in got and (4, "BANK_CARD") not in got
    once = rules.with_rules(each.limit(0), each, "doc_id")
    assert once.count() == once.select("doc_id", "entity_type", "value").distinct().count()


def test_statistics_and_selection(spark):
    found = detect(docs(spark, "13812345678 a@b.org", "x"))
    r = batch_statistics(found).first()
    assert (r.total_texts, r.total_entities, r.texts_with_entities, r.rate) == (2, 2, 1, 0.5)
    assert r.by_method == {"llm": 0, "regex": 2} and r.by_type == {"CHINA_PHONE": 1, "EMAIL": 1}
    assert batch_statistics(found.limit(0)).first().rate == 0
    sizes = found.select(F.size(at_least("entities", 0.81)).alias("a"), F.size(of_types("entities", ["EMAIL"])).alias("b")).first()
    assert (sizes.a, sizes.b) == (0, 1)
    assert spark.range(1).select(F.size(no_entities())).first()[0] == 0


def test_configs(tmp_path):
    good = "recognizers:\n  - entity_type: US_PHONE\n    confidence_base: 0.8\n    patterns:\n      - pattern: '\\d{3}-\\d{4}'\n    context_words: ['tel']\n"
    (tmp_path / "b.yaml").write_text(good)
    (tmp_path / "a.yaml").write_text("recognizers: 3")
    (tmp_path / "p.yaml.txt").write_text("hi: 'say {text}'")
    with pytest.warns(UserWarning):
        entries = configs.load_all(tmp_path)
    assert len(entries) == 1 and from_config(entries[0]).context_words == ("tel",)
    assert configs.prompt("p.yaml.txt", "hi", tmp_path) == "say {text}"
    with pytest.raises(KeyError):
        configs.prompt("p.yaml.txt", "no", tmp_path)
    with pytest.raises(FileNotFoundError):
        configs.load_all(tmp_path / "none")
    for bad in ({}, {"entity_type": "X", "patterns": []}, {"entity_type": "X", "patterns": [{}]}, {"entity_type": "X", "patterns": [{"pattern": "a"}], "confidence_base": 3}, {"entity_type": "X", "patterns": [{"pattern": "a"}], "deny_lists": "x"}):
        with pytest.raises(ValueError):
            configs.check(bad)


def test_data_sets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("张 B-PER\n三 I-PER\n\n京 B-LOC\nbad\n")
    got = datasets.tagged_text(spark, str(tmp_path / "t.txt")).orderBy("sentence").collect()
    assert [(r.tokens, r.ner_tags) for r in got] == [(["张", "三"], ["B-PER", "I-PER"]), (["京"], ["B-LOC"])]
    (tmp_path / "s.jsonl").write_text('{"input": "a", "output": {"entities": []}}\nnot json\n{"input": "b"}\n')
    assert datasets.json_lines(spark, str(tmp_path / "s.jsonl"), most=1).first().input == "a"
    assert datasets.json_lines(spark, str(tmp_path / "s.jsonl"), keep_corrupt=True).cache().where("_corrupt_record is not null").count() == 1
    for k, text in enumerate(('[{"input": "a"}]', '{"train": [{"input": "a"}]}')):
        (tmp_path / f"d{k}.json").write_text(text)
        assert datasets.json_document(spark, str(tmp_path / f"d{k}.json")).first().input == "a"
    assert datasets.existing(spark, [str(tmp_path / "s.jsonl"), str(tmp_path / "none")]).count() == 3
    rows = prepare.split(prepare.generate(spark, {"EMAIL": 20}), "input")
    datasets.write_splits(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    names = datasets.write_named_splits(rows, str(tmp_path / "all"))
    assert [n.rsplit("/", 1)[1] for n in names] == ["all_train.jsonl", "all_validation.jsonl", "all_test.jsonl"]
    assert [datasets.json_lines(spark, n).count() for n in names] == [16, 2, 2]
    rows.limit(3).write.parquet(str(tmp_path / "saved" / "train"))
    rows.limit(2).write.parquet(str(tmp_path / "saved" / "extra"))
    assert datasets.saved(spark, str(tmp_path / "saved")).count() == 3 and datasets.saved(spark, str(tmp_path / "saved"), "test").count() == 2
    assert datasets.saved(spark, str(tmp_path / "saved" / "extra")).count() == 2
    datasets.write_document(rows.limit(2), str(tmp_path / "d.json"))
    with pytest.raises(ValueError):
        datasets.write_document(rows, str(tmp_path / "d.json"), most=19)
    lines = "".join(f"t{k} B-X\n" + "\n" * (k % 3 == 0) for k in range(3000))
    (tmp_path / "long.txt").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = datasets.tagged_text(spark, str(tmp_path / "long.txt")).orderBy("sentence").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [t for r in got for t in r.tokens] == [f"t{k}" for k in range(3000)] and {len(r.tokens) for r in got} <= {1, 2, 3}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail ann@real.org now\nnothing\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    a = anonymize.Anonymizer({"r": anonymize.redact()}, default="r")
    run = anonymized_stream(stream, a).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.anonymized_text for r in spark.table("streamed").collect()} == {"mail [EMAIL] now", "nothing"}


def test_answers_leave_in_bounded_runs():
    """Prompts of one large batch are not all asked, nor held, before the first answers leave the task."""
    import pyarrow as pa

    from veilspan.operators.model import Calls, _asking

    asked = []

    class Sizes:
        def generate(self, prompt, system_prompt=None, temperature=0.0, max_tokens=512):
            asked.append(len(prompt))
            return str(len(prompt))

    prompts = ["x" * (k % 40_000) if k % 7 else None for k in range(3_000)]
    batch = pa.record_batch({"id": pa.array(range(len(prompts)), pa.int64()), "prompt": pa.array(prompts, pa.string())})
    out = _asking(lambda: Calls(Sizes, width=2), "prompt", "response", lambda x: x and f"<{x}>")(iter([batch]))
    first = next(out)
    assert sum(asked) < 4 << 20 and first.num_rows < 2_000
    got = pa.Table.from_batches([first, *out]).to_pydict()
    assert got["id"] == list(range(len(prompts))) and got["response"] == [None if p is None else f"<{len(p)}>" for p in prompts]


class Louder:
    def generate(self, prompt, system_prompt=None, temperature=0.0, max_tokens=512):
        return prompt.upper()


def test_nested_columns_and_nulls_beside_answers(spark):
    """Columns beside the prompt come back as they were."""
    rows = spark.createDataFrame([(None, "a", [("x", None)]), (3, None, None)], "n long, prompt string, own array<struct<a: string, b: int>>")
    got = model.ask(rows, Louder).collect()
    assert [(r.n, r.prompt, r.own, r.response) for r in got] == [(None, "a", [("x", None)], "A"), (3, None, None, None)]


def test_hybrid_detection_has_one_python_step(spark):
    """Answers are taken apart where they arrive: a second worker of each task would hold texts beside the first."""
    rows = hybrid_detect(docs(spark, "mail a@b.org"), "deep", lambda x: model.model_detect(x, Louder, "{text}"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan


def test_texts_travel_once(spark):
    """A text goes to a task's Python and back once: its prompt is made there."""
    rows = hybrid_detect(docs(spark, "mail a@b.org"), "deep", lambda x: model.model_detect(x, Louder, "Find in {text}"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    step = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "__prompt" not in step and step.count("text#") == 2


class Repeats:
    """Its answer names the prompt."""

    def generate(self, prompt, system_prompt=None, temperature=0.0, max_tokens=512):
        return json.dumps({"entities": [{"type": "PROMPT", "value": prompt, "start": 0, "end": 1}]})


@pytest.mark.parametrize("template", ["{text}", "a {{b}} {text} c", "{text}|{text}", "{text}{text", "none", "{{text}}", ""])
def test_prompts_made_in_tasks(spark, template):
    """They are those that ``rendered`` gives, in bounded runs; blank texts have none."""
    texts = ["hi", "x{text}y", " \t", "  ", "", None, "\u00a0", "é漢"]
    rows = docs(spark, *texts).withColumn("s", F.struct(F.col("text").alias("t"))).withColumn("n", F.col("doc_id").cast("int"))
    want = {r.doc_id: r.p for r in rows.select("doc_id", model.rendered(template, F.col("text")).alias("p")).collect()}
    got = model.model_detect(rows, Repeats, template, ("PROMPT",), into="found")
    assert got.columns == [*rows.columns, "found"]
    for once in (False, True):
        found = {r.doc_id: [e.value for e in r.found] for r in model.model_detect(rows, Repeats, template, ("PROMPT",), into="found", once=once).collect()}
        assert found == {k: [want[k]] if (t or "").strip(" ") and want[k] else [] for k, t in enumerate(texts)}
    nested = {r.doc_id: [e.value for e in r.found] for r in model.model_detect(rows, Repeats, template, ("PROMPT",), text="s.t", into="found").collect()}
    assert nested == found
    numbers = {r.n: [e.value for e in r.found] for r in model.model_detect(rows, Repeats, "{text}!", ("PROMPT",), text="n", into="found").collect()}
    assert numbers == {k: [f"{k}!"] for k in range(len(texts))}


def test_runs_are_bounded_by_their_prompts():
    """A long template counts in every row's prompt."""
    import pyarrow as pa

    from veilspan.operators.model import Calls, _asking

    batch = pa.record_batch({"text": pa.array(["ab"] * 3_000, pa.string())})
    out = list(_asking(lambda: Calls(Louder), "text", "response", lambda x: str(len(x)), "x" * 10_000 + "{text}")(iter([batch])))
    assert max(x.num_rows for x in out) < 110 and [n for x in out for n in x.column("response").to_pylist()] == ["10002"] * 3_000


def test_context_is_cut_once(spark):
    """The window around an entity stands once in a plan, however many keywords are counted in it."""
    rows = detect(docs(spark, "手机 13812345678"), Registry([Recognizer("PHONE_NUMBER", (r"1[3-9]\d{9}",), base=0.45)]))
    rows = rows.withColumn("entities", refine.validate_context(F.col("entities"), F.col("text")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(substring(text") + plan.count("lower(substr(text") == 1
