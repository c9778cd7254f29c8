"""Preparing labelled data: converting corpora, uniting, splitting, normalising, generating and rendering samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import ID_DIGITS, ID_WEIGHTS
from ..functions.spans import let
from ..functions.types import CANONICAL, literal_map, normalize_type
from .tables import PLACEHOLDERS, TAGS

SPAN = "struct<type: string, value: string, start: int, end: int>"
SPANS = f"array<{SPAN}>"
INSTRUCTION = "Find the personal data in the text."


def _span(kind: Column, value: Column, start: Column, end: Column) -> Column:
    return F.struct(kind.alias("type"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def sample(text: Column, spans: Column, instruction: str = INSTRUCTION) -> list[Column]:
    """The columns of a training sample: instruction, input and output."""
    return [F.lit(instruction).alias("instruction"), text.alias("input"), F.struct(spans.alias("entities")).alias("output")]


def placeholder_type(name: Column) -> Column:
    """The type of a masked corpus's placeholder by the first rule that its name fits; null if none does."""
    out = F.lit(None).cast("string")
    for parts, kind in reversed(PLACEHOLDERS):
        out = F.when(F.upper(name).rlike(parts), kind).otherwise(out)
    return out


def mask_spans(text: Column, mask: Column) -> Column:
    """Spans of a masked corpus from its map of placeholder to value; the first place of each value counts."""

    def one(entry: Column) -> Column:
        at = F.call_function("locate", entry["value"], text)
        kind = placeholder_type(entry["key"])
        found = kind.isNotNull() & (F.length(entry["value"]) > 0) & (at > 0)
        return F.when(found, _span(kind, entry["value"], at - 1, at - 1 + F.length(entry["value"])))

    return F.array_compact(F.transform(F.map_entries(mask), one))


def labelled_mask_spans(text: Column, mask: Column) -> Column:
    """The same from an array of (value, start, end, label), whose positions are taken as given."""

    def one(m: Column) -> Column:
        kind = placeholder_type(m["label"])
        return F.when(kind.isNotNull(), _span(kind, m["value"], m["start"], m["end"]))

    return F.array_compact(F.transform(mask, one))


def from_masks(rows: DataFrame, text: str = "source_text", mask: str = "privacy_mask") -> DataFrame:
    """Training samples of a masked corpus; rows without a usable span go. The mask may be a map or an array of structs."""
    spans = mask_spans if rows.schema[mask].dataType.typeName() == "map" else labelled_mask_spans
    out = rows.withColumn("__spans", spans(F.col(text), F.col(mask)).cast(SPANS)).where(F.size("__spans") > 0)
    return out.select(*sample(F.col(text), F.col("__spans")))


def bio_spans(tokens: Column, tags: Column, types: Mapping[str, str] = TAGS) -> Column:
    """Spans of a sentence from tokens and B-/I-/O tags.

    B- opens a span, I- extends whatever is open, anything else closes; an I- without a span is nothing. Positions are those in the tokens joined
    without a gap. A type without a canonical name keeps its own.
    """
    state = f"struct<at: int, done: {SPANS}, open: {SPAN}>"

    def step(s: Column, x: Column) -> Column:
        token, tag = x["token"], x["tag"]
        end = s["at"] + F.length(token)
        begins, goes_on = tag.startswith("B-"), tag.startswith("I-") & s["open"].isNotNull()
        done = F.when(s["open"].isNotNull() & ~goes_on, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        name = F.substr(tag, F.lit(3), F.length(tag))
        new = _span(F.coalesce(F.element_at(literal_map(types), name), name), token, s["at"], end)
        longer = _span(s["open"]["type"], F.concat(s["open"]["value"], token), s["open"]["start"], end)
        return F.struct(end.alias("at"), done.alias("done"), F.when(begins, new).when(goes_on, longer).alias("open")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("done"), F.lit(None).cast(SPAN).alias("open")).cast(state)
    return F.aggregate(F.arrays_zip(tokens.alias("token"), tags.alias("tag")), start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def numbered_tags(tags: Column) -> Column:
    """Tags 0 to 6 as names: O, then B- and I- of persons, organisations and places."""
    names = F.array(*map(F.lit, ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")))
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(names, t.cast("int") + 1), F.lit("O")))


def from_bio(rows: DataFrame, tokens: str = "tokens", tags: str = "ner_tags") -> DataFrame:
    """Training samples of tagged sentences; sentences without an entity go. Tags may be names or numbers."""
    numbered = "string" not in rows.schema[tags].dataType.simpleString()
    names = numbered_tags(F.col(tags)) if numbered else F.col(tags)
    out = rows.withColumn("__spans", bio_spans(F.col(tokens), names)).where(F.size("__spans") > 0)
    return out.select(*sample(F.array_join(tokens, ""), F.col("__spans")))


def hash_order(*keys: str, seed: int = 42) -> Column:
    """A fixed random order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by a column, of rows with equal values any.

    Ranges of the column, cut at a bounded sample of its values, are counted; only the range that holds the last row is sorted. Nulls come first.
    """
    cuts = sorted({r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(256).collect()})
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) + 1, F.lit(0)) if cuts else F.lit(0)
    ranged = rows.withColumn("__part", F.when(F.col(order).isNull(), 0).otherwise(part))
    seen = 0
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():  # 258 rows at most
        if seen + r["count"] > n:
            whole = ranged.where(F.col("__part") < r["__part"])
            return whole.unionAll(ranged.where(F.col("__part") == r["__part"]).orderBy(order).limit(n - seen)).drop("__part")
        seen += r["count"]
    return rows


def ratio_union(sources: Mapping[str, tuple[DataFrame, float]], order: str) -> DataFrame:
    """The first int(n * ratio) rows of each source, by ``order``, with the source's name."""
    out = None
    for name, (rows, ratio) in sources.items():
        if not 0 <= ratio <= 1:
            raise ValueError(f"{name}: the ratio must be within 0 and 1")
        part = (rows if ratio == 1 else first_rows(rows, order, int(rows.count() * ratio))).withColumn("source_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split(rows: DataFrame, *keys: str, parts: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Add ``split``: train, validation or test, of exactly int(n * part) rows, in hashed order.

    The two thresholds are places in that order. They are found by counting the rows in ranges of the hash, and only
    the ranges that hold a threshold are sorted.
    """
    hashed = rows.withColumn("__h", hash_order(*keys, seed=seed)).withColumn("__range", F.left("__h", F.lit(3)))
    counts = hashed.groupBy("__range").count().orderBy("__range").collect()  # at most 4096 rows
    n = sum(r["count"] for r in counts)
    limits = (int(n * parts[0]), int(n * parts[0]) + int(n * parts[1]))
    edges: dict[str, int] = {}  # ranges that a threshold divides, and the rows before them
    names = ("train", "validation", "test")
    first: list[tuple[str, str]] = []  # names of the other ranges, each from its first range on
    seen = 0
    for r in counts:
        if any(seen < x < seen + r["count"] for x in limits):
            edges[r["__range"]] = seen
        elif not first or first[-1][1] != (name := names[sum(seen >= x for x in limits)]):
            first.append((r["__range"], names[sum(seen >= x for x in limits)]))
        seen += r["count"]
    whole = F.lit(None).cast("string")
    for begin, name in first:
        whole = F.when(F.col("__range") >= begin, name).otherwise(whole)
    outer = (hashed.where(~F.col("__range").isin(*edges)) if edges else hashed).withColumn("split", whole)
    if edges:
        before = F.lit(0)
        for at, size in edges.items():
            before = F.when(F.col("__range") == at, size).otherwise(before)
        place = before + F.row_number().over(Window.partitionBy("__range").orderBy("__h", *keys)) - 1
        inner = hashed.where(F.col("__range").isin(*edges)).withColumn("split", F.when(place < limits[0], names[0]).when(place < limits[1], names[1]).otherwise(names[2]))
        outer = outer.unionByName(inner)
    return outer.drop("__h", "__range")


def conversion_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a conversion, the share kept, and spans for each sample."""
    a = before.agg(F.count("*").alias("rows_in"))
    b = after.agg(F.count("*").alias("rows_out"), F.coalesce(F.avg(F.size("output.entities")), F.lit(0.0)).alias("mean_entities"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return one.withColumn("rate", F.when(F.col("rows_in") > 0, F.col("rows_out") / F.col("rows_in")).otherwise(0.0))


def normalized_types(rows: DataFrame, spans: str = "entities") -> DataFrame:
    """The spans with canonical type names, and how many of each row changed."""
    new = F.transform(spans, lambda s: s.withField("type", normalize_type(s["type"])))
    changed = F.size(F.filter(F.zip_with(spans, new, lambda a, b: a["type"] != b["type"]), lambda x: x))
    return rows.withColumn("changed", changed).withColumn(spans, new)


def type_changes(rows: DataFrame, spans: str = "entities") -> DataFrame:
    """(type, normalized, n, standard): every type name in use, what it becomes and how often it occurs."""
    each = rows.select(F.explode(f"{spans}.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return each.select("type", normalize_type(F.col("type")).alias("normalized"), "n", F.col("type").isin(*CANONICAL).alias("standard"))


def consistency(rows: DataFrame, spans: str = "entities", corrupt: str | None = "_corrupt_record") -> DataFrame:
    """One row: samples, invalid ones (null spans or a corrupt record), and entities with standard and other type names."""
    bad = F.col(spans).isNull()
    if corrupt and corrupt in rows.columns:
        bad = bad | F.col(corrupt).isNotNull()
    kinds = F.transform(F.when(~bad, F.col(spans)), lambda s: s["type"])
    known = F.coalesce(F.size(F.filter(kinds, lambda t: t.isin(*CANONICAL))), F.lit(0))
    total = F.when(kinds.isNotNull(), F.size(kinds)).otherwise(0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("samples"), F.count_if(bad).alias("invalid"), zero(known).alias("standard"), zero(total - known).alias("other"))


def chat(rows: DataFrame, system: str = INSTRUCTION) -> DataFrame:
    """Add ``chat``: a sample's turns between start and end marks, the spans as JSON."""
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    return rows.withColumn("chat", F.concat(turn("system", F.lit(system)), turn("user", F.col("input")), turn("assistant", F.to_json("output"))))


def luhn_digit(digits: Column) -> Column:
    """The digit that completes a number of digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(places, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def id_digit(first_17: Column) -> Column:
    total = sum((F.substr(first_17, F.lit(k + 1), F.lit(1)).cast("int") * w for k, w in enumerate(ID_WEIGHTS)), F.lit(0))
    return F.substr(F.lit(ID_DIGITS), F.pmod(total, F.lit(11)) + 1, F.lit(1))


#: The characters of a social credit code in the order of their numbers.
CREDIT_CODE = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def credit_code_digit(first_17: Column) -> Column:
    """The character that completes a social credit code: weights are powers of 3 modulo 31."""
    total = sum(((F.instr(F.lit(CREDIT_CODE), F.substr(first_17, F.lit(k + 1), F.lit(1))) - 1) * pow(3, k, 31) for k in range(17)), F.lit(0))
    return F.substr(F.lit(CREDIT_CODE), F.pmod(F.lit(31) - F.pmod(total, F.lit(31)), F.lit(31)) + 1, F.lit(1))


def _number(row: Column, salt: str, size: int) -> Column:
    """``size`` digits that the row and the salt fix."""
    return F.lpad(F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(10**size)).cast("string"), size, "0")


def _pick(row: Column, salt: str, items: tuple[str, ...] | str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(len(items))) + 1).cast("int"))


def _value(kind: str, r: Column) -> Column:
    digits, pick = (lambda salt, n: _number(r, salt, n)), (lambda salt, items: _pick(r, salt, items))
    hexes = lambda salt, n: F.left(F.md5(F.concat(r.cast("string"), F.lit(salt)).cast("binary")), F.lit(n))
    octet = lambda salt: F.pmod(F.xxhash64(r, F.lit(salt)), F.lit(254)).cast("string")
    if kind == "PHONE_NUMBER":
        return F.concat(F.lit("1"), pick("p", "3456789"), digits("q", 9))
    if kind == "EMAIL":
        return F.concat(F.lit("user"), digits("e", 5), F.lit("@mail"), digits("f", 2), F.lit(".org"))
    if kind == "ID_CARD":
        month = F.lpad((F.pmod(F.xxhash64(r, F.lit("m")), F.lit(12)) + 1).cast("string"), 2, "0")
        day = F.lpad((F.pmod(F.xxhash64(r, F.lit("d")), F.lit(28)) + 1).cast("string"), 2, "0")
        first = F.concat(pick("a", ("110101", "310104", "440301", "320106")), F.lit("19"), F.lit("8"), digits("y", 1), month, day, digits("s", 3))
        return let(first, lambda x: F.concat(x, id_digit(x)))
    if kind == "BANK_CARD":
        return let(F.concat(F.lit("62"), digits("b", 13)), lambda x: F.concat(x, luhn_digit(x)))
    if kind == "PASSPORT":
        return F.concat(F.lit("E"), digits("t", 8))
    if kind == "DRIVER_LICENSE":
        return digits("l", 12)
    if kind == "VEHICLE_PLATE":
        return F.concat(pick("v", ("京", "沪", "粤", "苏")), pick("w", "ABCDEFGH"), digits("x", 5))
    if kind == "IP_ADDRESS":
        return F.concat_ws(".", octet("1"), octet("2"), octet("3"), octet("4"))
    if kind == "MAC_ADDRESS":
        return F.regexp_replace(F.upper(hexes("c", 12)), "(..)(?=.)", "$1:")
    if kind == "POSTAL_CODE":
        return F.concat(pick("z", "123456"), digits("o", 5))
    if kind == "TAX_ID":
        return let(F.concat(F.lit("91"), digits("g", 6), F.upper(hexes("h", 9))), lambda x: F.concat(x, credit_code_digit(x)))
    if kind == "IPV6_ADDRESS":
        return F.regexp_replace(hexes("v6", 32), "(....)(?=.)", "$1:")
    if kind == "HK_MACAU_PASS":
        return F.concat(pick("hk", "CH"), digits("hm", 8))
    if kind == "SOCIAL_SECURITY":
        return digits("k", 10)
    if kind == "IMEI":
        return let(F.concat(F.lit("35"), digits("i", 12)), lambda x: F.concat(x, luhn_digit(x)))
    if kind == "VIN":
        return F.concat(F.lit("L"), F.upper(F.translate(hexes("n", 16), "io", "jp")))
    if kind == "PERSON_NAME":
        return F.concat(pick("j", ("王", "李", "张", "刘")), pick("u", ("伟", "芳", "敏", "静", "强")))
    if kind == "ADDRESS":
        return F.concat(pick("r", ("北京市海淀区", "上海市黄浦区")), pick("aa", ("中山路", "人民路")), digits("bb", 2), F.lit("号"))
    return F.concat(pick("cc", ("华东", "北方")), pick("dd", ("科技", "贸易")), F.lit("有限公司"))


#: A sentence for each type; the value stands for {}.
TEMPLATES = {
    "PHONE_NUMBER": "晚上七点以后打{}最容易找到人。",
    "EMAIL": "附件已转发到 {} ，请查收。",
    "ID_CARD": "登记表第三栏填写的是{}，核对无误。",
    "BANK_CARD": "退款退回尾号所在的卡 {} ，三天内到账。",
    "PASSPORT": "出境时查验的证件为 {} 。",
    "DRIVER_LICENSE": "租车前需出示驾照，编码 {} 。",
    "VEHICLE_PLATE": "地库出口拍到的车是{}。",
    "IP_ADDRESS": "昨夜的登录来自 {} 。",
    "IPV6_ADDRESS": "新机房的网关设为 {} 。",
    "MAC_ADDRESS": "打印机接口标签写着 {} 。",
    "POSTAL_CODE": "包裹寄往邮区 {} 。",
    "IMEI": "维修单上的机身串码是 {} 。",
    "VIN": "挡风玻璃下方刻有 {} 。",
    "TAX_ID": "开票时抬头后面写 {} 。",
    "SOCIAL_SECURITY": "参保记录查询编号 {} 。",
    "HK_MACAU_PASS": "过关时刷的是 {} 。",
    "PERSON_NAME": "会议由{}主持。",
    "ADDRESS": "快递放在{}门卫处。",
    "ORGANIZATION": "合同的甲方是{}。",
}


def generate(spark: SparkSession, quotas: Mapping[str, int], mixed: float = 0.3, seed: str = "") -> DataFrame:
    """Training samples with ``quotas`` rows of each type; a share of them holds a second sentence with another type.

    Values follow from the row's number and the seed; check digits are valid.
    """
    _known(quotas)
    out = None
    for kind, n in quotas.items():
        rows = spark.range(n).select(*_sampled(kind, F.xxhash64("id", F.lit(kind + seed)), mixed))
        out = rows if out is None else out.unionAll(rows)
    return out


def _known(kinds: Iterable[str]) -> None:
    if unknown := set(kinds) - set(TEMPLATES):
        raise ValueError(f"no template for {sorted(unknown)}")


def _sampled(kind: str, r: Column, mixed: float) -> list[Column]:
    """A sample of a type whose values follow from a number."""
    kinds = list(TEMPLATES)

    def parts(name: str, at: Column) -> tuple[Column, Column]:
        before, after = TEMPLATES[name].split("{}")
        value = _value(name, r)
        span = let(value, lambda v: _span(F.lit(name), v, at + len(before), at + len(before) + F.length(v)))
        return F.concat(F.lit(before), value, F.lit(after)), span

    text, span = parts(kind, F.lit(0))
    text2, span2 = parts(kinds[(kinds.index(kind) + 1) % len(kinds)], F.length(text))
    both = F.pmod(r, F.lit(100)) < int(mixed * 100)
    return sample(F.when(both, F.concat(text, text2)).otherwise(text), F.when(both, F.array(span, span2)).otherwise(F.array(span)))


def generate_for(rows: DataFrame, key: str, kinds: Sequence[str] = tuple(TEMPLATES), mixed: float = 0.3, seed: str = "") -> DataFrame:
    """A training sample for every row of a table: ``key``, ``kind`` and the sample's columns.

    The key fixes the type, one of ``kinds``, and the values, so that a table's samples stay the same as it grows.
    """
    _known(kinds)
    names = [*kinds]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(names))) + 1).cast("int"))
    made = None
    for name in names:
        one = F.struct(*_sampled(name, F.xxhash64(key, F.lit(name + seed)), mixed))
        made = F.when(F.col("kind") == name, one) if made is None else made.when(F.col("kind") == name, one)
    return rows.select(key, kind.alias("kind")).withColumn("made", made).select(key, "kind", "made.*")


def template_samples(spark: SparkSession, each: int = 3) -> DataFrame:
    """At most three samples of every type, for checks by eye."""
    return generate(spark, dict.fromkeys(TEMPLATES, min(each, 3)), mixed=0.0)
