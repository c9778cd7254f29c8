"""Language identification by fusing evidence in log-odds.

For each language, a row's score adds up
- the likelihood of its text under hashed byte trigrams, fitted on a bounded sample of labelled documents,
- how often rows of that language declare the language that the row's markup declares,
- the prior of its host, shrunk towards that of its address suffix, shrunk towards that of all rows.

Declarations and priors are learnt without labels: one grouped aggregation each over the texts' own posteriors. A row's own
posterior is taken out of its host's and suffix's counts, so that it isn't counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from .common import CHUNK_BYTES, chunks, cut, give_back

#: Labelled documents of each language that the trigrams are fitted on, at most.
SAMPLE = 1000
BUCKETS = 1 << 15
#: A text counts as this many independent trigrams at most; neighbours overlap and words repeat.
STRENGTH = 60.0
#: Rows' worth of the wider prior that a host's or a suffix's own counts are mixed with.
PULL = 10.0
LEAST_SCORE = 0.5
#: Counts of hosts, suffixes or declarations by language are broadcast up to this many numbers, keys of the sample up to this many rows.
BROADCAST_CELLS = 500_000


def _buckets(buf: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte but the last two; A-Z are lowered."""
    x = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17)).astype(np.intp)


def _inner(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First trigram and number of trigrams of each text."""
    return offsets[:-1], np.maximum(np.diff(offsets) - 2, 0)


@dataclass(frozen=True)
class Trigrams:
    languages: list[str]
    weights: np.ndarray  # bucket x language, log probabilities


def fit(docs: DataFrame, sample: int = SAMPLE) -> Trigrams:
    """Fit on at most ``sample`` texts of each language, chosen by a hash, so that rare languages are known as well.

    Every language with a labelled text is in the model. Of equal rows one teaches. The driver gets the trigram counts by language and bucket.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("key"))
    # a language's rows are thinned by their hash to about twice the sample before they meet in one task
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    turn = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    near = rows.select("lang", "key").join(sizes, "lang").withColumn("turn", turn).where(F.col("turn") * F.col("n") < 2 * sample + 100)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "key"))
    keys = cut(near.select("lang", "key", "turn").distinct().withColumn("place", place).where(F.col("place") <= sample).select("lang", "key"))
    rows = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_CELLS else keys, ["lang", "key"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column("text").filter(pa.array(langs == lang))
                n = np.zeros(BUCKETS, np.int64)
                for _, _, buf, offsets in chunks(own):
                    if len(buf) > 2:
                        at, size = _inner(offsets)
                        inside = np.zeros(len(buf) + 1, np.int64)
                        np.add.at(inside, at, 1)
                        np.add.at(inside, at + size, -1)
                        n += np.bincount(_buckets(buf)[np.cumsum(inside)[: len(buf) - 2] > 0], minlength=BUCKETS)
                found = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n[found])], names=["lang", "bucket", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pandas()
    languages = sorted(set(table["lang"]))
    n = np.full((BUCKETS, len(languages)), 0.5, np.float32)  # 128 KB a language
    if len(table):
        n[table["bucket"].to_numpy(), np.searchsorted(languages, table["lang"])] += table["n"].to_numpy()
    return Trigrams(languages, np.log(n / n.sum(axis=0, dtype=np.float64)).astype(np.float32) if languages else n)


def _likelihoods(model: Trigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.astype(np.float32)
        for batch in batches:
            out, sizes = [np.zeros((0, weights.shape[1]))], [np.zeros(0, int)]
            for a, b, buf, offsets in chunks(batch.column("__text"), CHUNK_BYTES // 4):
                at, size = _inner(offsets)
                sums = np.zeros((b - a, weights.shape[1]))
                if len(buf) > 2:
                    bucket = _buckets(buf)
                    for k in range(weights.shape[1]):
                        each = np.append(0.0, np.cumsum(weights[bucket, k], dtype=np.float64))
                        sums[:, k] = each[np.minimum(at + size, len(bucket))] - each[np.minimum(at, len(bucket))]
                out.append(sums / np.maximum(size, 1)[:, None] * np.minimum(size, STRENGTH)[:, None])
                sizes.append(size)
            flat = np.concatenate(out)
            ends = pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (flat, _posterior(flat))]
            arrays = [*batch.drop_columns(["__text"]).columns, pa.array(np.concatenate(sizes), pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(c for c in batch.schema.names if c != "__text"), "__n", "__text_score", "__p"])
        give_back()

    return run


def _posterior(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.fill_null([0.0] * n).flatten().to_numpy(zero_copy_only=False).reshape(len(column), n) if column.null_count else column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def _summed(n: int):
    """(value, posterior) to the sums by value and language of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").dictionary_encode()
            sums = np.zeros((len(values.dictionary), n))
            np.add.at(sums, values.indices.to_numpy(), _matrix(batch.column("p"), n))
            at, language = np.nonzero(sums)
            yield pa.record_batch([values.dictionary.take(pa.array(at)), pa.array(language.astype(np.int32)), pa.array(sums[at, language])], names=["value", "language", "n"])

    return run


def _counts(scored: DataFrame, value: Column, n: int) -> DataFrame:
    """(value, language, n): the posteriors of the rows with a text, summed by a value and by language."""
    rows = scored.where("__n > 0").select(value.alias("value"), F.col("__p").alias("p")).where(F.col("value").isNotNull())
    return rows.mapInArrow(_summed(n), "value string, language int, n double").groupBy("value", "language").agg(F.sum("n").alias("n"))


def _fused(names: list[str], overall: np.ndarray, pull: float):
    """Posteriors from a row's likelihoods, its own part in each count, and the counts of its suffix, host and declaration."""
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column("__n").to_numpy() > 0
            own = np.where(some[:, None], _matrix(batch.column("__p"), n), 0.0)

            def shrunk(by: str, wider: np.ndarray, own=own, batch=batch) -> np.ndarray:
                """Counts without the row's own part, mixed with the wider prior."""
                counted = batch.column(by)
                rest = np.maximum(np.where(counted.is_null().to_numpy(zero_copy_only=False)[:, None], 0.0, _matrix(counted, n) - own), 0.0)
                return (rest + pull * wider) / (rest.sum(axis=1, keepdims=True) + pull)

            prior = shrunk("__host_n", shrunk("__suffix_n", overall))
            # P(declared | language), up to a factor that all languages share: the language's share among the rows that declare so, over its share of all
            said = np.where(batch.column("__declared").is_null().to_numpy(zero_copy_only=False)[:, None], 0.0, np.log(shrunk("__declared_n", overall) / overall))
            posterior = _posterior(_matrix(batch.column("__text_score"), n) + np.log(prior) + said)
            best = posterior.argmax(axis=1)
            lang = pa.array([names[k] for k in best.tolist()], pa.string(), mask=~some)
            yield pa.record_batch([batch.column("__key"), lang, pa.array(np.where(some, posterior[np.arange(len(best)), best], 0.0))], names=["__key", "lang", "score"])

    return run


def identify(rows: DataFrame, model: Trigrams, key: str, text: Column, declared: Column | None, suffix: Column | None, host: Column | None, pull: float = PULL, least: float = LEAST_SCORE) -> DataFrame:
    """(key, lang, score, kept) of every row; score is the posterior of lang. Of languages with equal posteriors the first by name is taken.

    Evidence that is null, or not given, says nothing. A text without a word is no text. Rows whose text has no trigram, or whose best language scores under
    ``least``, are not kept; a row without a trigram has a null lang and score 0. Keys may be null or repeat. Only ``key`` and what the expressions name
    is read. Without any language in the model no row is identified. Work grows in proportion to the number of languages.
    """
    names, n = model.languages, len(model.languages)
    given = [by for by, c in (("__suffix", suffix), ("__host", host), ("__declared", declared)) if c is not None]
    declared, suffix, host = (F.lit(None).cast("string") if c is None else c for c in (declared, suffix, host))
    kind = rows.schema[key].dataType.simpleString()
    base = rows.select(F.col(key).alias("__key"), F.lower(F.substring(declared, 1, 2)).alias("__declared"), suffix.cast("string").alias("__suffix"), host.cast("string").alias("__host"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), text.cast("string")).alias("__text"))
    if not names:
        return base.select(F.col("__key").alias(key), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    schema = f"__key {kind}, __declared string, __suffix string, __host string, __n long, __text_score array<double>, __p array<double>"
    scored = cut(base.mapInArrow(_likelihoods(model), schema))

    def counts(by: str) -> DataFrame:
        """A row for each value; broadcast only if there are few, else joined by a shuffle in which nulls are spread."""
        each = cut(_counts(scored, F.col(by), n))
        found = F.map_from_entries(F.collect_list(F.struct("language", "n")))
        table = each.groupBy(F.col("value").alias("__value")).agg(found.alias("__found"))
        known = let(F.col("__found"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))))
        table = table.select("__value", known.alias(f"{by}_n"))
        return F.broadcast(table) if each.select("value").distinct().count() * n <= BROADCAST_CELLS else table

    overall = np.ones(n)
    for r in _counts(scored, F.lit(""), n).collect():  # a row for each language
        overall[r.language] += r.n
    overall /= overall.sum()

    out = scored
    for by in ("__suffix", "__host", "__declared"):
        if by in given:
            value = F.coalesce(by, F.concat(F.lit("\0"), F.pmod(F.hash("__key"), F.lit(4096))))  # no value begins so
            out = out.withColumn("__value", value).join(counts(by), "__value", "left").drop("__value")
        else:
            out = out.withColumn(f"{by}_n", F.lit(None).cast("array<double>"))
    out = out.select("__key", "__declared", "__n", "__text_score", "__p", "__suffix_n", "__host_n", "__declared_n")
    out = out.mapInArrow(_fused(names, overall, pull), f"__key {kind}, lang string, score double").withColumnRenamed("__key", key)
    return out.withColumn("kept", F.col("lang").isNotNull() & (F.col("score") >= least))


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, score, kept) of documents: text and the source as host. The rows' lang is read for fitting only."""
    return identify(docs, fit(docs), "doc_id", F.col("text"), None, None, F.col("source"))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, score, kept) of web pages, with a model fitted on labelled documents."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    host = F.when(F.length(host) > 0, host)
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2})""", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[A-Za-z#0-9]+;", " ")
    return identify(pages, fit(docs), "page_id", text, F.when(F.length(declared) > 0, declared), F.substring_index(host, ".", -1), host)
