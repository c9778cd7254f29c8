"""Queries over data sets on their way in and out, and over calls to a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.model import ask_once, rendered
from ..sources.arrow_files import arrow_dataset, save_arrow_dataset
from ..sources.datasets import json_document
from ..sources.json_documents import write_json_arrays
from ..sources.storage import new_folder
from .registry import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, min(doc_id) AS least, max(doc_id) AS most FROM documents GROUP BY lang")
def arrow_dataset_round_trip(spark, sf_dir):
    """Documents saved as an Arrow data set of two splits, of which the training one is read again, three of its columns."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = new_folder(spark, "arrow")
    save_arrow_dataset(docs.where("doc_id % 10 = 0"), path, "test")
    save_arrow_dataset(docs, path, "train")
    rows = arrow_dataset(spark, path, "doc_id long, text string, lang string")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


@query("SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, bit_xor(hash) AS digest FROM (SELECT source, text, ('0x' || left(md5(doc_id || ':' || text), 15))::BIGINT AS hash FROM documents) GROUP BY source")
def json_documents_round_trip(spark, sf_dir):
    """Documents written as JSON arrays, a file a task, and read again in blocks that begin anywhere."""
    path = new_folder(spark, "json")
    write_json_arrays(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    rows = json_document(spark, path, "doc_id long, text string, source string")
    number = F.conv(F.left(F.md5(F.concat_ws(":", "doc_id", "text").cast("binary")), F.lit(15)), 16, 10).cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.bit_xor(number).alias("digest"))


class _Backwards:
    """A stand-in for a model: it says a prompt backwards."""

    def generate(self, prompt, system_prompt=None, temperature=0.0, max_tokens=512):
        return prompt[::-1]


@query("SELECT conv_id, turn, reverse('Sum up {' || left(text, 24) || '}: ' || role) AS response FROM conversations")
def model_batches(spark, sf_dir):
    """Every distinct prompt is asked once, eight calls of a task at a time."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", rendered("Sum up {{{text}}}", F.left("text", F.lit(24))), "role").alias("prompt"))
    return ask_once(rows, _Backwards, width=8).select("conv_id", "turn", "response")
