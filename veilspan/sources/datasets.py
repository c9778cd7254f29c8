"""Labelled data sets as tables: JSON lines, JSON arrays, tagged text, and their sinks. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_files import arrow_dataset
from .json_documents import json_elements

ENTITY = "struct<type: string, value: string, start: int, end: int>"
SAMPLE = f"instruction string, input string, output struct<entities: array<{ENTITY}>>"
CASE = f"text string, entities array<{ENTITY}>"


def json_lines(spark: SparkSession, path: str | list[str], schema: str = SAMPLE, most: int | None = None, keep_corrupt: bool = False) -> DataFrame:
    """One row for each line; ``most`` keeps the first lines of a single file in their order. With ``keep_corrupt``, lines that don't parse stay in _corrupt_record."""
    if keep_corrupt:
        schema += ", _corrupt_record string"
    if most is None:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n")).orderBy("n").limit(most)
    options = {"mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": "_corrupt_record"} if keep_corrupt else {})
    return lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: str = SAMPLE, part: str = "train") -> DataFrame:
    """The rows of a JSON array, or of one part of an object of arrays, in any number of tasks; a document must be valid, an element of another form gives nulls."""
    return json_elements(spark, path, part).select(F.from_json("value", f"struct<{_colons(schema)}>").alias("r")).select("r.*")


def _colons(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).simpleString()[len("struct<") : -1]


def existing(spark: SparkSession, paths: Iterable[str], schema: str = SAMPLE) -> DataFrame:
    """The JSON lines of those paths that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    return json_lines(spark, there, schema) if there else spark.createDataFrame([], schema)


def tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, tokens, ner_tags) of a file with a token and a tag on each line and a blank line after each sentence.

    Lines with fewer than two parts end a sentence if they are blank and are left out otherwise; a last sentence without a blank line counts. The
    file is read in the order of its lines: each task numbers the blank lines of its part, and the parts' totals are added up.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    lines = lines.select("n", F.shiftright("n", 33).alias("part"), parts.alias("p"), (F.length(F.trim("value")) == 0).cast("long").alias("blank"))
    totals = lines.groupBy("part").agg(F.sum("blank").alias("blanks"))  # a row for each part of the file
    before = F.coalesce(F.sum("blanks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(totals.select("part", before.alias("before")), "part")
    lines = lines.withColumn("sentence", F.col("before") + F.sum("blank").over(Window.partitionBy("part").orderBy("n")))
    words = lines.where((F.col("blank") == 0) & (F.size("p") >= 2)).groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("n", F.col("p")[0].alias("t"), F.element_at("p", -1).alias("g")))).alias("w"))
    return words.select("sentence", F.col("w.t").alias("tokens"), F.col("w.g").alias("ner_tags"))


def saved(spark: SparkSession, path: str, prefer: str = "train") -> DataFrame:
    """A saved data set in Parquet or Arrow: the preferred split if the folder has one, else its first by name, else the folder itself."""

    def listed(where: str):
        folder = spark._jvm.org.apache.hadoop.fs.Path(where)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)

    entries = listed(path)
    splits = sorted(x.getPath().getName() for x in entries if x.isDirectory() and not x.getPath().getName().startswith(("_", ".")) and "=" not in x.getPath().getName())
    chosen = f"{path}/{prefer if prefer in splits else splits[0]}" if splits else path
    arrow = any(x.getPath().getName().endswith(".arrow") for x in listed(chosen))
    return arrow_dataset(spark, chosen) if arrow else spark.read.parquet(chosen)


def write_splits(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, a folder for each split."""
    rows.write.partitionBy(by).mode("overwrite").json(path)


def write_named_splits(rows: DataFrame, stem: str, by: str = "split", names: Iterable[str] = ("train", "validation", "test")) -> list[str]:
    """JSON lines as ``<stem>_<split>.jsonl``, each a folder of part files, without the column ``by``; returns the paths."""
    out = []
    for name in names:
        rows.where(F.col(by) == name).drop(by).write.mode("overwrite").json(path := f"{stem}_{name}.jsonl")
        out.append(path)
    return out


def write_document(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A small result, such as a report, as a JSON file on the driver; a result of more than ``most`` rows is refused."""
    import json

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them as JSON lines")
    with open(path, "w", encoding="utf-8") as out:
        json.dump([r.asDict(recursive=True) for r in found], out, ensure_ascii=False, indent=2, default=str)
