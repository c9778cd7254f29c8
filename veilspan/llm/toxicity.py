"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is its log-odds ratio between toxic and other training documents under a symmetric
Dirichlet prior, less two standard errors; tokens without significant odds cost a little. A token is known by the whole
word or, where the word itself is not significant, by its first bytes, so that inflected words count. One linear
scan finds every maximal segment of a text. By extreme-value theory the number of chance segments with a score of at least
S in n tokens is about K n exp(-lambda S); lambda solves the score distribution of clean documents and K is set by how many of
them exceed a score. A text's evidence is the sum of -log10 of that number over its significant segments, and a
logistic curve turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, mix, signed

#: Training documents of each label at most, chosen by a hash of the id. The bound holds for fitting only.
SAMPLE = 5000
PRIOR = 0.5
#: Hashes by which copies among the training documents are found.
MARKS = 1
LEAST_Z = 3.5
#: The same among documents without a more significant token.
LEAST_OWN_Z = 2.0
COST = 0.1
HEADS = (6, 5, 4)
#: Segments with more chance occurrences than this in their text are not reported.
MOST_CHANCE = 0.05

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 32


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    w = Words(_PLAIN[buf], offsets)
    return w, [w.hashes(0), *(w.heads(k) for k in HEADS)]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least of each of several hashes of a text's three-token grams; copies share most of them."""
    for batch in batches:
        for a, b, buf, offsets in chunks(batch.column("text")):
            w, keys = _tokens(buf, offsets)
            lane, sums = w.sequence(0, keys[0])
            grams = lane.ranges(sums, np.arange(len(w)), np.minimum(np.arange(len(w)) + 3, w.first[1:][w.doc]))
            edges = list(zip(w.first[:-1], w.first[1:], strict=True))
            marks = [pa.array(signed(np.array([mix(grams[x:y] ^ np.uint64(k)).min() if y > x else 0 for x, y in edges], np.uint64))) for k in range(MARKS)]
            yield pa.record_batch([batch.column(c)[a:b] for c in ("doc_id", "text", "toxic")] + marks, names=["doc_id", "text", "toxic", *(f"mark{k}" for k in range(MARKS))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (token, toxic documents, other documents) of each batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        tokens, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b, buf, offsets in chunks(batch.column("text")):
            w, keys = _tokens(buf, offsets)
            for k in range(b - a):
                own = slice(w.first[k], w.first[k + 1])
                found = np.unique(np.concatenate([x[own] for x in keys]))
                tokens.append(found[found != 0])
                labels.append(np.full(len(tokens[-1]), toxic[a + k], np.int64))
        token, at = np.unique(np.concatenate(tokens), return_inverse=True)
        label = np.concatenate(labels)
        n1 = np.bincount(at, label, len(token)).astype(np.int64)
        n = np.bincount(at, minlength=len(token)).astype(np.int64)
        yield pa.record_batch([pa.array(signed(token)), pa.array(n1), pa.array(n - n1)], names=["token", "n1", "n0"])


def segments(at: np.ndarray, scores: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one scan and linear time.

    ``at`` and ``scores`` give the positions with a score of their own; the others cost ``cost`` each. Each segment keeps
    the index of the nearest earlier one that begins at a smaller sum, so that a search never walks over a segment twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with a smaller sum before
    total, next_at = 0.0, 0
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total -= (p - next_at) * cost
        next_at = p + 1
        if s > 0:
            first, before, after, k = p, total, total + s, len(found) - 1
            while True:
                while k >= 0 and found[k][2] >= before:
                    k = found[k][4]
                if k < 0 or found[k][3] >= after:
                    found.append((first, p + 1, before, after, k))
                    break
                first, _, before, _, link = found[k]
                del found[k:]
                k = link
        total += s
    return [(a, b, y - x) for a, b, x, y, _ in found]


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray
    scores: np.ndarray
    rate: float = 1.0  # lambda
    chance: float = 1.0  # K
    slope: float = 1.0
    offset: float = 0.0

    def token_scores(self, keys: list[np.ndarray]) -> np.ndarray:
        """A score for each token by the first of its forms that the model knows; NaN if none."""
        out = np.full(len(keys[0]), np.nan)
        if len(self.tokens):
            for form in reversed(keys):
                k = np.minimum(np.searchsorted(self.tokens, form), len(self.tokens) - 1)
                out = np.where(self.tokens[k] == form, self.scores[k], out)
        return out

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(start, end, score, chance occurrences) of the significant segments of a text."""
        at = np.flatnonzero(~np.isnan(scores))
        found = ((a, b, s, self.chance * len(scores) * math.exp(-min(700.0, self.rate * s))) for a, b, s in segments(at, scores[at], COST))
        return [x for x in found if x[3] <= MOST_CHANCE]

    def probability(self, passages: list) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * evidence(passages) + self.offset))))


def evidence(passages: list) -> float:
    return math.log1p(sum(-math.log10(max(x[3], 1e-300)) for x in passages))


def _present(tokens: np.ndarray):
    """(text, toxic) to (toxic, the model's tokens in the text, by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, keys = _tokens(buf, offsets)
                at = [np.minimum(np.searchsorted(tokens, x), len(tokens) - 1) for x in keys]
                at = [np.where(tokens[k] == x, k, -1) for k, x in zip(at, keys, strict=True)]
                rows = [np.unique(np.concatenate([x[w.first[k] : w.first[k + 1]] for x in at])) for k in range(b - a)]
                yield pa.record_batch([batch.column("toxic")[a:b], pa.array([x[x >= 0] for x in rows], pa.list_(pa.int64()))], names=["toxic", "tokens"])

    return run


def _telling(rows: list, significance: np.ndarray) -> np.ndarray:
    """Which toxic tokens say something that no more significant one says.

    In order of significance, a token is judged on the sample documents that hold none of those kept so far.
    Words that only occur beside abuse, as in copies of one document, are left with no toxic document of their own.
    """
    holders: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        for t in r.tokens:
            holders.setdefault(t, []).append(k)
    toxic, told = np.array([r.toxic for r in rows], bool), np.zeros(len(rows), bool)
    kept = np.zeros(len(significance), bool)
    for t in np.argsort(-significance, kind="stable").tolist():
        own = np.array(holders.get(t, []), int)
        new = own[~told[own]]
        y1, y0 = int(toxic[new].sum()), int((~toxic[new]).sum())
        n1, n0 = int((toxic & ~told).sum()), int((~toxic & ~told).sum())
        odds = math.log((y1 + PRIOR) / (n1 - y1 + PRIOR)) - math.log((y0 + PRIOR) / (n0 - y0 + PRIOR))
        if odds > LEAST_OWN_Z * math.sqrt(1 / (y1 + PRIOR) + 1 / (y0 + PRIOR)):
            kept[t] = True
            told[own] = True
    return kept


def _known(model: Model):
    """(text, toxic) to (toxic, number of tokens, highest segment score, evidence under the model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, keys = _tokens(buf, offsets)
                scores = model.token_scores(keys)
                best, told = [], []
                for k in range(b - a):
                    own = scores[w.first[k] : w.first[k + 1]]
                    at = np.flatnonzero(~np.isnan(own))
                    best.append(max((x[2] for x in segments(at, own[at], COST)), default=0.0))
                    told.append(evidence(model.passages(own)))
                yield pa.record_batch([batch.column("toxic")[a:b], pa.array(w.counts, pa.int64()), pa.array(best, pa.float64()), pa.array(told, pa.float64())], names=["toxic", "n", "best", "evidence"])

    return run


def _score_counts(model: Model):
    """(text, toxic) to (score, n): how often each score occurs in the texts that are not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            clean = batch.filter(pa.array(batch.column("toxic").to_numpy(zero_copy_only=False) == 0))
            for _, _, buf, offsets in chunks(clean.column("text")):
                scores = model.token_scores(_tokens(buf, offsets)[1])
                found.append(scores[~np.isnan(scores)])
            score, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(score), pa.array(n.astype(np.int64))], names=["score", "n"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each label whose id is not held out.

    Rows with a null id or label teach nothing, nor do labels that contradict each other, and of copies and most near copies
    one teaches. The driver gets the significant tokens of the sample, which toxic ones each of its documents has, and figures for each document.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = known.where("toxic = 1").orderBy(order).limit(sample).unionAll(known.where("toxic = 0").orderBy(order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # at most 2 * sample rows are broadcast
    # one of each group of copies: their words would pass for so many independent observations
    marks = [f"mark{k}" for k in range(MARKS)]
    texts = cut(texts.mapInArrow(_marked, "doc_id long, text string, toxic int, " + ", ".join(f"{x} long" for x in marks)))
    single = texts.select("doc_id", "toxic", *marks)
    for mark in marks:  # the least id stays, whatever the order of rows
        single = single.groupBy("toxic", F.col(mark).alias("__mark")).agg(F.min(F.struct("doc_id", *marks)).alias("least")).select("toxic", "least.*")
    texts = cut(texts.join(single.select("doc_id"), "doc_id", "left_semi").select("text", "toxic"))
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), slope=0.0, offset=math.log((n1 + 0.5) / (n0 + 0.5)))

    counts = texts.mapInArrow(_counted, "token long, n1 long, n0 long").groupBy("token").agg(F.sum("n1").alias("y1"), F.sum("n0").alias("y0"))
    odds = lambda y, n: F.log((F.col(y) + PRIOR) / (n + PRIOR - F.col(y)))
    error = F.sqrt(1 / (F.col("y1") + PRIOR) + 1 / (F.col("y0") + PRIOR))
    counts = counts.withColumn("odds", odds("y1", n1) - odds("y0", n0)).withColumn("error", error).where(F.abs("odds") > LEAST_Z * F.col("error"))
    rows = counts.select("token", (F.col("odds") / F.col("error")).alias("z"), (F.signum("odds") * (F.abs("odds") - 2 * F.col("error"))).alias("score")).collect()
    tokens = np.array([r.token for r in rows], np.int64).view(np.uint64)
    by = np.argsort(tokens)
    tokens, scores, z = tokens[by], np.array([r.score for r in rows])[by], np.array([r.z for r in rows])[by]
    bad = np.flatnonzero(z > 0)
    if len(bad):
        held = texts.mapInArrow(_present(tokens[bad]), "toxic int, tokens array<long>").collect()
        kept = z < 0
        kept[bad] = _telling(held, z[bad])
        tokens, scores = tokens[kept], scores[kept]
    model = Model(tokens, scores)

    figures = "toxic int, n long, best double, evidence double"
    clean = [r for r in texts.mapInArrow(_known(model), figures).collect() if not r.toxic]
    counts = texts.mapInArrow(_score_counts(model), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()  # a row for each score of the model at most
    counts.sort(key=lambda r: r.score)  # sums of doubles follow their order
    total = sum(r.n for r in clean) + 1
    high = float(np.median(model.scores[model.scores > 0])) if (model.scores > 0).any() else 1.0
    own, times = np.array([r.score for r in counts] + [high]), np.array([r.n for r in counts] + [1])  # one chance occurrence more than seen

    def mean_power(rate: float) -> float:
        return ((times * np.exp(rate * own)).sum() + (total + 1 - times.sum()) * math.exp(-rate * COST)) / (total + 1)

    low, top = 1e-3, 1e-3
    while mean_power(top) < 1 and top < 100:
        low, top = top, top * 2
    for _ in range(60):
        middle = (low + top) / 2
        low, top = (middle, top) if mean_power(middle) < 1 else (low, middle)
    over = (sum(r.best >= high for r in clean) + 0.5) / (len(clean) + 1)
    length = max(1.0, total / max(1, len(clean)))
    chance = -math.log1p(-min(over, 0.999)) / (length * math.exp(-low * high))
    model = Model(model.tokens, model.scores, low, chance)

    told = sorted(texts.mapInArrow(_known(model), figures).collect(), key=lambda r: (r.evidence, r.toxic))
    x, y = np.array([r.evidence for r in told]), np.array([r.toxic for r in told], float)
    slope, offset = _logistic(x, y)
    return Model(model.tokens, model.scores, low, chance, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one feature, with a slight pull of the slope towards 0."""
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * np.array([beta[0], 0])
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row; a passage is (start, end, score, chance) in tokens, end exclusive.

    A null or empty text has no passage and the score of a text without evidence. Null ids and repeated rows stay. Only doc_id and
    text are read, and doc_id is only passed through.
    """
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                w, keys = _tokens(buf, offsets)
                scores = model.token_scores(keys)
                found = [model.passages(scores[w.first[k] : w.first[k + 1]]) for k in range(b - a)]
                rows = [[dict(zip(("start", "end", "score", "chance"), x, strict=True)) for x in y] for y in found]
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(map(model.probability, found), pa.float64()), pa.array(rows, pa.list_(passage))], names=["doc_id", "score", "passages"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, passages array<struct<start: int, end: int, score: double, chance: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row, with a model fitted on labelled rows that are not held out."""
    out = scored(docs, fit(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
