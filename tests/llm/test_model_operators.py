"""Mixing, neighbours, toxicity, language identification and the pipeline, held against brute force and held-out labels."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import ann, language_id, mixing, toxicity

from .conftest import as_rows, awkward_rows, rows_of, split_words

DOCS, LABELS = "/root/testdata/sf0.01/documents.parquet", "/root/testdata/sf0.01/labels.parquet"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(split_words(t))
    targets = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len(split_words(t))) for i, t, *_ in rows if i is not None)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) * r.size == r.taken
    return sizes, targets


def test_mixing_targets_and_takes(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "w " * int(rng.integers(1, 30)), "en", f"s{int(rng.integers(0, 9)) if k % 3 else 0}") for k in range(3000)]
    docs = as_rows(spark, rows)
    got = mixing.mixture(docs, block_rows=32).collect()
    sizes, targets = check_mix(rows, got)
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 31
    again = mixing.mixture(docs.repartition(7), block_rows=32)
    assert rows_of(again) == sorted((tuple(r) for r in got), key=repr)
    full = mixing.shuffled(docs, block_rows=32)
    assert full.count() == sum(len(r.shards) for r in got)
    assert full.columns == [*docs.columns, "shard"]


def test_mixing_awkward_rows(awkward, clashing, empty):
    rows = awkward_rows()
    for table in (awkward, clashing):
        check_mix(rows, mixing.mixture(table).collect())
    assert rows_of(mixing.mixture(empty)) == []
    assert mixing.shuffled(empty).count() == 0
    assert set(mixing.shuffled(clashing).columns) == set(clashing.columns)


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 8), (3, 0), (4, 17)], "source long, quota long")
    lefts = []
    for seed in range(40):
        tree = mixing.splitting_tree(quotas, 2, seed).collect()
        by = defaultdict(list)
        for r in tree:
            by[r.source].append((r.shard, r.lo, r.hi))
        for source, quota in ((1, 40), (2, 8), (3, 0), (4, 17)):
            spans = sorted(by[source])
            assert spans[0][1] == 0 and spans[-1][2] == quota and all(a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))
        totals = Counter()
        for r in tree:
            totals[r.shard] += r.hi - r.lo
        assert max(totals.values()) - min(totals.values()) <= 1
        lefts.append(sum(r.hi - r.lo for r in tree if r.source == 1 and r.shard < 2))
    # mean n * K / N = 32 * 40 / 65, variance n K/N (1 - K/N) (N - n)/(N - 1)
    assert abs(np.mean(lefts) - 32 * 40 / 65) < 1.2 and 0.8 < np.std(lefts) < 3.2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf string, v string, block string")


def brute_neighbours(rows, k=5):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    out = {}
    for q in ids[ids % 50 == 0]:
        others = ids != q
        s = ann.cosines(x[others], x[ids == q][0])
        best = np.lexsort((ids[others], -s))[:k]
        out[int(q)] = list(zip(ids[others][best].tolist(), s[best].tolist(), strict=True))
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16))
    rows = [(k, (centers[k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(3000)]
    rows += [(5000 + k, rows[50][1]) for k in range(400)]  # one very common vector
    rows += [(7000, None), (7050, [0.0] * 16), (7100, [float("nan")] + [1.0] * 15), (7150, [float("inf")] + [1.0] * 15), (7200, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows = [(*r, 1, "x", "y", "z") for r in rows]
    expected = brute_neighbours(rows)
    got = defaultdict(list)
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, leaf=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(expected)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 5 for q in expected]) >= 0.9
    assert got[50] == expected[50]  # ties go to the smaller id
    assert {q: got[q] for q in got if {i for i, _ in got[q]} == {i for i, _ in expected[q]}}.items() <= expected.items()


def test_neighbours_of_few_rows(spark):
    one = [(50, [1.0, 0.0], 0, "", "", ""), (3, [1.0, 1.0], 0, "", "", ""), (4, [0.0, 2.0], 0, "", "", "")]
    got = ann.search(vectors(spark, one), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 3), (50, 2, 4)] and got[1].score == 0.0
    assert ann.search(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert ann.search(vectors(spark, one[:1]), F.col("vec_id") % 50 == 0).collect() == []


def test_neighbours_by_row_length_and_size(spark):
    """Rows that share an id are rows of their own; vectors of another length take no part; large and tiny components count."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (3, [2e200, 1e200]), (4, [1e-200, 3e-200]), (5, [1.0]), (100, [1.0, 2.0, 3.0]), (6, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(table, F.col("vec_id") % 50 == 0).collect()))
    near = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    flat = {"a": [1.0, 0.0], "b": [1.0, 0.1], "3": [2.0, 1.0], "4": [1.0, 3.0]}
    wanted = []
    for me, other in (("a", "b"), ("b", "a")):
        own = [(6, 1.0 if me == "a" else near(flat["b"], flat["a"])), (50, near(flat[me], flat[other])), (3, near(flat[me], flat["3"])), (4, near(flat[me], flat["4"]))]
        wanted += [(50, n, i, pytest.approx(s)) for n, (i, s) in enumerate(sorted(own, key=lambda x: (-round(x[1], 12), x[0])), 1)]
    assert len(got) == 8 and all(np.isfinite(r[3]) for r in got)
    key = lambda r: (r[1], r[2], round(float(getattr(r[3], "expected", r[3])), 9))
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_leaves_stay_small(spark):
    """Large leaves are split until they hold few rows, but equal vectors stay together; no row is lost."""
    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(3000)] + [(9000 + k, [1.0] * 8) for k in range(300)]
    table = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    first = ann.grow(ann._unit(np.array([v for _, v in rows[:60]])), leaf=30)
    tree, indexed = ann.refined(table, first, leaf_rows=100)
    sizes = sorted(r["count"] for r in indexed.groupBy("leaf").count().collect())
    assert sum(sizes) == 3300 and first.leaves < 12 and len(sizes) > 30 and sizes[-2] <= 100
    assert sorted(tree.leaf[tree.leaf >= 0].tolist()) == list(range(tree.leaves)) and len(set(tree.best_bins(np.ones(8)))) == tree.leaves
    got = defaultdict(set)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, leaf_rows=100).collect():
        got[r.query_id].add(r.vec_id)
    expected = brute_neighbours(rows)
    assert np.mean([len(got[q] & {i for i, _ in expected[q]}) / 5 for q in expected]) >= 0.9


def brute_segments(x):
    """Maximal segments by their definition: the best segment, then the same on both sides of it."""
    if not len(x):
        return []
    sums = np.concatenate([[0], np.cumsum(x)])
    best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    i, j = best[3], best[4]
    return brute_segments(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(x[j:])]


def test_all_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.choice([-0.1, -0.1, -1.7, 1.3, 2.9, 0.37], rng.integers(1, 25)) + rng.random() * 1e-3
        at = np.flatnonzero(x > -0.05) if rng.random() < 0 else np.arange(len(x))
        got = toxicity.segments(at, x[at], 0.1)
        assert sorted((a, b) for a, b, _ in got) == brute_segments(x)
        assert all(s == pytest.approx(x[a:b].sum()) for a, b, s in got)


def test_segments_take_linear_time():
    """Costs drift the sum down, so that nearly every token opens a segment: the walk back must not grow."""
    import time

    took = []
    for n in (32_000, 128_000):
        at = np.arange(n) * 30
        began = time.perf_counter()
        assert len(toxicity.segments(at, np.full(n, 1.0), 0.1)) == n
        took.append(time.perf_counter() - began)
    assert took[0] < 1 and took[1] < 12 * took[0] + 0.2
    rng = np.random.default_rng(2)
    x = np.where(rng.random(3000) < 0.5, -1, 1) * rng.random(3000)  # a long walk: many merges
    assert sorted((a, b) for a, b, _ in toxicity.segments(np.arange(3000), x, 0.1)) == brute_segments_fast(x)


def brute_segments_fast(x):
    out, todo = [], [(0, len(x))]
    sums = np.concatenate([[0], np.cumsum(x)])
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        low = np.minimum.accumulate(sums[i:j])
        gain = sums[i + 1 : j + 1] - low
        if gain.max() <= 1e-12:
            continue
        e = i + 1 + int(np.argmax(gain))
        s = i + int(np.argmin(sums[i:e]))
        out.append((s, e))
        todo += [(i, s), (e, j)]
    return sorted(out)


def test_segments_skip_background():
    full = np.array([-0.1, 2.0, -0.1, -0.1, 3.0, -0.1, -5.0, 1.0])
    sparse = toxicity.segments(np.array([1, 4, 6, 7]), full[[1, 4, 6, 7]], 0.1)
    assert [(a, b) for a, b, _ in sparse] == [(1, 5), (7, 8)] and sparse[0][2] == pytest.approx(4.8)


def test_toxicity_on_held_out_labels(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeioubdst"), 5)) for _ in range(500)]
    rows, labels = [], []
    for k in range(900):
        own = rng.choice(words, 80).tolist()
        bad = k % 4 == 0
        for at in rng.choice(80, 3, replace=False) if bad else ():
            own[at] = rng.choice(["scumbag", "vermine", "vermines", "rotters"])
        rows.append((k, " ".join(own), "en", "a"))
        labels.append((k, 1, int(bad)))
    labels += [(None, 1, 1), (3, None, None)]
    truth = dict((k, y) for k, _, y in labels[:900])
    got = toxicity.toxicity(as_rows(spark, [*rows, (2000, None, None, None), (None, "", None, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 902
    out = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    tested = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    bad = next(r for r in tested if truth[r.doc_id] and r.passages)
    words_of = dict((k, t) for k, t, *_ in rows)[bad.doc_id].split()
    assert any(w in ("scumbag", "vermine", "vermines", "rotters") for p in bad.passages for w in words_of[p.start : p.end])


def test_toxicity_scores_by_definition(spark, clashing):
    """Scores from the fitted figures by brute force: every maximal segment, its chance, the evidence and the logistic curve."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeioubdst"), 5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        own = rng.choice(words, 60).tolist()
        if k % 3 == 0:
            own[5:7] = ["scumbag", "rotter"]
        rows.append((k, " ".join(own), "en", "a"))
        labels.append((k, 1, int(k % 3 == 0)))
    labels += [(1, 1, 1), (0, 1, 0)]  # contradictory labels teach nothing
    docs, known = as_rows(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for k, text, *_ in rows[:60]:
        tokens = text.lower().split()
        _, keys = toxicity._tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        scores = model.token_scores(keys)
        full = np.where(np.isnan(scores), -toxicity.COST, scores)
        told = 0.0
        for a, b in brute_segments_fast(full):
            chance = model.chance * len(tokens) * np.exp(-model.rate * full[a:b].sum())
            told += -np.log10(chance) if chance <= toxicity.MOST_CHANCE else 0.0
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log1p(told) + model.offset))), rel=1e-6)
    # the rate solves the clean documents' distribution: one chance occurrence of the median positive score more than seen
    clean = [k for k in range(400) if k % 3 and k != 1 and zlib.crc32(str(k).encode()) % 5]
    own, total = [float(np.median(model.scores[model.scores > 0]))], 2
    for k in clean:
        text = rows[k][1].encode()
        scores = model.token_scores(toxicity._tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1])
        own += scores[~np.isnan(scores)].tolist()
        total += len(scores)
    power = (np.exp(model.rate * np.array(own)).sum() + (total - len(own)) * np.exp(-model.rate * toxicity.COST)) / total
    assert power == pytest.approx(1, abs=1e-3)
    assert rows_of(toxicity.scored(clashing, model).drop("passages")) == rows_of(toxicity.scored(clashing.select("doc_id", "text"), model).drop("passages"))
    long = as_rows(spark, [(1, "scumbag fine " * 200_000, "en", "a")])
    assert toxicity.scored(long, model).first().score > 0.5


def test_toxicity_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, none).collect()
    assert len(got) == len(awkward_rows()) and all(r.score == 0.5 for r in got)
    assert toxicity.toxicity(empty, none).collect() == []


def test_toxicity_does_not_follow_the_order_of_rows(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    copies = docs.unionByName(docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 100_000))
    more = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 100_000))
    found = []
    for parts, order in ((1, F.col("doc_id")), (7, F.xxhash64("doc_id")), (3, -F.col("doc_id"))):
        mixed = copies.repartition(parts, "doc_id").sortWithinPartitions(order)
        found.append(sorted((r.doc_id, r.score) for r in toxicity.toxicity(mixed, more.repartition(parts).sortWithinPartitions(order)).collect()))
    assert found[0] == found[1] == found[2]


def test_languages_of_documents(spark, awkward, clashing, empty):
    docs = spark.read.parquet(DOCS)
    found = language_id.document_languages(docs.withColumn("lang", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang"))))
    tested = found.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where(F.pmod("doc_id", F.lit(2)) == 1)
    assert tested.where("lang = truth").count() / tested.count() > 0.98
    for table in (awkward, clashing):
        got = language_id.document_languages(table).collect()
        assert len(got) == len(awkward_rows())
        assert all((r.lang is None) == (r.score == 0) and r.kept == (r.lang is not None and r.score >= 0.5) for r in got)
    assert language_id.document_languages(empty).collect() == []


def brute_languages(rows, labelled, pull=10.0, strength=60.0):
    """(lang, score) of (text, declared, suffix, host) rows, in plain loops over the definition."""

    def buckets(text):
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
        return [(((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 17 for k in range(len(b) - 2)]

    names = sorted({lang for _, lang in labelled})
    logs = []
    for name in names:
        n = Counter(x for text, lang in labelled if lang == name for x in buckets(text))
        total = sum(n.values()) + 0.5 * language_id.BUCKETS
        logs.append(lambda x, n=n, total=total: float(np.float32(np.log((n[x] + 0.5) / total))))
    soft = lambda xs: [np.exp(x - max(xs)) / sum(np.exp(y - max(xs)) for y in xs) for x in xs]
    scores, posts = [], []
    for text, *_ in rows:
        own = buckets(text) if text and text.encode().split() else []
        scores.append([sum(map(w, own)) / len(own) * min(len(own), strength) if own else 0.0 for w in logs])
        posts.append(soft(scores[-1]) if own else None)
    zero = [0.0] * len(names)
    add = lambda ps: [sum(p[k] for p in ps) for k in range(len(names))] if ps else zero
    overall = [x + 1 for x in add([p for p in posts if p])]
    overall = [x / sum(overall) for x in overall]

    def shrunk(k, column, wider):
        value = rows[k][column]
        rest = add([p for j, p in enumerate(posts) if p and j != k and rows[j][column] == value]) if value is not None else zero
        return [(a + pull * w) / (sum(rest) + pull) for a, w in zip(rest, wider, strict=True)]

    out = []
    for k, (row, score, post) in enumerate(zip(rows, scores, posts, strict=True)):
        if post is None:
            out.append((None, 0.0))
            continue
        prior = shrunk(k, 3, shrunk(k, 2, overall))
        said = [np.log(a / w) for a, w in zip(shrunk(k, 1, overall), overall, strict=True)] if row[1] is not None else zero
        post = soft([a + np.log(b) + c for a, b, c in zip(score, prior, said, strict=True)])
        out.append((names[int(np.argmax(post))], max(post)))
    return out


def test_languages_by_definition(spark):
    rng = np.random.default_rng(12)
    words = {"aa": "the and of with that", "bb": "der die und nicht ein", "cc": "le la et pas une"}
    labelled = [(" ".join(rng.choice(words[x].split(), 6)), x) for x in words for _ in range(8)]
    rows = [("", None, None, None), (None, "aa", "s1", "h1"), ("xx", None, "s1", None)]
    for k in range(60):
        x = "abc"[k % 3] * 2
        rows.append((" ".join(rng.choice(words[x].split() + ["zz"], rng.integers(1, 5))), rng.choice([None, "aa", "bb", "cc"]), f"s{k % 2}", rng.choice([None, "h1", "h2", "h3"])))
    docs = as_rows(spark, [(k, t, x, "s") for k, (t, x) in enumerate(labelled)])
    table = spark.createDataFrame([(k, *(None if v is None else str(v) for v in r)) for k, r in enumerate(rows)], "id long, t string, said string, suffix string, host string")
    got = {r.id: r for r in language_id.identify(table, language_id.fit(docs), "id", *(F.col(c) for c in ("t", "said", "suffix", "host"))).collect()}
    for k, (lang, score) in enumerate(brute_languages(rows, labelled)):
        assert got[k].score == pytest.approx(score, rel=1e-5, abs=1e-9) and (got[k].lang == lang or score < 0.5 + 1e-6), rows[k]
    many = as_rows(spark, [(k, f"word{k} text {k}", f"l{k:03d}", "s") for k in range(150)])
    assert len(language_id.fit(many).languages) == 150  # no language is left out


def test_many_languages(spark):
    """The work is in proportion to the number of languages."""
    import time

    took = {}
    for n in (60, 500):
        rows = [(k, f"word{k % n} zq{k % n}x text{k % n} {k % n}{k % n}", f"l{k % n:03d}", f"s{k % 7}") for k in range(600)]
        docs = as_rows(spark, rows)
        model = language_id.fit(docs)
        assert len(model.languages) == n
        began = time.time()
        got = {r.doc_id: r.lang for r in language_id.identify(docs, model, "doc_id", F.col("text"), None, None, F.col("source")).collect()}
        took[n] = time.time() - began
        assert sum(got[k] == lang for k, _, lang, _ in rows) > 0.9 * len(rows)
    assert took[500] < 20 * took[60] and took[500] < 60, took


def test_evidence_is_fused(spark):
    """A text that says little follows its host, and its markup beats its host."""
    rows = [(k, ("the and of with that " if k % 2 else "der die und nicht ein ") * 12, "en" if k % 2 else "de", "x") for k in range(60)]
    docs = as_rows(spark, rows)
    model = language_id.fit(docs)
    pages = [(k, rows[k % 60][1], "en" if k % 2 else "de", "de", "h.de" if k % 2 == 0 else "h.com") for k in range(40)]
    pages += [(100, "x1", None, "de", "h.de"), (101, "x1", None, "com", "h.com"), (102, "x1", "en", "de", "h.de"), (103, "", "en", "de", "h.de"), (104, None, None, None, None)]
    table = spark.createDataFrame(pages, "page_id long, t string, said string, suffix string, host string")
    got = {r.page_id: r for r in language_id.identify(table, model, "page_id", *(F.col(c) for c in ("t", "said", "suffix", "host"))).collect()}
    assert got[100].lang is None and got[103].lang is None and not got[104].kept  # too short for a trigram
    table = spark.createDataFrame([(i, (t or "") + "xyz" if i >= 100 else t, *rest) for i, t, *rest in pages], "page_id long, t string, said string, suffix string, host string")
    got = {r.page_id: r for r in language_id.identify(table, model, "page_id", *(F.col(c) for c in ("t", "said", "suffix", "host"))).collect()}
    assert got[100].lang == "de" and got[101].lang == "en"
    assert got[102].score < got[100].score or got[102].lang == "en"
    assert all(got[k].lang == ("en" if k % 2 else "de") for k in range(40))


def test_pages(spark):
    from veilspan.llm.queries import language_id_pages

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("said"))
    got = language_id_pages(spark, "/root/testdata/sf0.001").join(pages, "page_id")
    assert got.where("lang = said").count() / got.count() > 0.95


def test_pipeline_stages(spark, awkward, tmp_path):
    """Each stage against a brute-force version of it on the stage's own input."""
    docs, names = awkward, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before, after = docs.collect(), out.collect()
        if name == "language_id":
            labelled = {(r.doc_id, r.text, r.lang) for r in before if r.text is not None and r.lang is not None}
            found = brute_languages([(r.text, None, None, r.source) for r in before], [x[1:] for x in labelled])
            assert Counter((r.doc_id, r.lang) for r in after) == Counter((r.doc_id, lang) for r, (lang, score) in zip(before, found, strict=True) if lang and score >= 0.5)
            assert all(r.lang and r.text and r.text.strip() for r in after)
        if name == "near_dedup":
            from .test_text_operators import brute_near

            kept = {i for i, _, _, keep in brute_near([(r.doc_id, r.text) for r in before], 5, 80) if keep and i is not None}
            assert {r.doc_id for r in after if r.doc_id is not None} == kept
            assert Counter(r.doc_id for r in after)[None] == Counter(r.doc_id for r in before)[None]
        if name == "secret_scan":
            from .test_text_operators import brute_secrets

            assert len(after) == len(before) and all(not any(brute_secrets(r.text)[:3]) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "source_mix":
            taken = Counter()
            for r in mixing.mixed(docs, columns=["doc_id", "text"]).collect():
                taken[r.row.doc_id, r.row.text] += r.copies
            assert Counter((r.doc_id, r.text) for r in after) == +taken
            sizes, words = defaultdict(list), Counter()
            for r in before:
                sizes[r.source].append(len(split_words(r.text)))
            for r in after:
                words[r.source] += len(split_words(r.text))
            for s, target in brute_targets({s: sum(x) for s, x in sizes.items()}).items():
                assert target - max(sizes[s]) < words[s] <= target + 1e-6
        if name == "bpe_codec":
            from .test_text_operators import library

            assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(library(r.text)[0])) for r in before)
        else:
            assert out.columns == corpus_pipeline.COLUMNS
        names.append(name)
        docs = out
    assert names == ["language_id", "near_dedup", "secret_scan", "source_mix", "bpe_codec"]


def test_near_dedup_keeps_one_row_of_a_group(spark):
    """Repeated rows, and copies under an id whose other text stays; rows without an id stay."""
    say = lambda k: " ".join(f"{chr(97 + k)}{j}" for j in range(60))
    near = say(0).replace("a59", "end")
    rows = [(1, say(0)), (1, say(0)), (2, say(0)), (2, say(1)), (2, say(1)), (3, near), (4, say(2)), (4, say(3)), (5, say(2)), (6, None), (6, None), (None, say(0)), (None, say(0))]
    rows = [(i, t, "en", s) for i, t in rows for s in ("a",)] + [(4, say(3), "en", "b")]
    got = corpus_pipeline.near_dedup(spark, as_rows(spark, rows), "").select("doc_id", "text", "source")
    wanted = [(1, say(0), "a"), (2, say(1), "a"), (4, say(2), "a"), (4, say(3), "a"), (6, None, "a"), (6, None, "a"), (None, say(0), "a"), (None, say(0), "a")]
    assert rows_of(got) == sorted(wanted, key=repr)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_pipeline_of_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
