"""A preparation pipeline over documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a table with the columns of
documents, the last one the encoded texts. Every stage's result is written as Parquet and read again as the
next one's docs, which also cuts the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm import bpe, mixing, secrets
from veilspan.llm.common import shared_folder
from veilspan.llm.language_id import fit, identify
from veilspan.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified, with that language as lang. A document without text goes."""
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = identify(keyed, fit(docs), "__row", F.col("text"), None, None, F.col("source"))
    found = found.where("kept").groupBy("__row").agg(F.first("lang").alias("__lang"))
    return keyed.join(found, "__row").withColumn("lang", F.col("__lang")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, the first by doc_id, hash of text, lang, source and n_chars.

    Rows without a word or an id are in no group and stay.
    """
    rows = near_duplicates(docs, shingle=5, percent=80, by_row=True).where("doc_id is not null").select("doc_id", "content", "root")
    kept = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("row")).select("row.*", F.lit(False).alias("__alone"))
    kept = kept.unionByName(rows.where("root is null").select("doc_id", "content", F.lit(True).alias("__alone")).distinct()).withColumnRenamed("content", "__content")
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("__content")).join(kept, ["doc_id", "__content"])
    turn = F.row_number().over(Window.partitionBy("doc_id", "__content").orderBy("lang", "source", "n_chars"))
    named = named.withColumn("__turn", turn).where("__turn = 1 or __alone").select(*COLUMNS)
    return named.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind."""
    return secrets.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a row for each time that the mix takes a document."""
    return mixing.shuffled(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every row, and a digest of what they decode to."""
    out = bpe.encode_decode(docs)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_codec", bpe_codec),
]

#: No SQL can express the fitted stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's table is deleted once its successor's is written; the last one stays for the result."""
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:
                old = spark._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            before = path
    return docs
