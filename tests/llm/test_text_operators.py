"""Substring dedup, BPE, token counts, near duplicates, quality rules and secrets against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import bpe, minhash, quality, secrets, substring_dedup, token_counts
from veilspan.llm.minhash import sketch

from .conftest import as_rows, awkward_rows, rows_of, split_words


def brute_dedup(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = split_words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = split_words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(awkward, clashing, empty):
    expected = brute_dedup(awkward_rows(), 50)
    got = substring_dedup.dedup_substrings(awkward, texts=True)
    assert rows_of(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == expected
    assert any(n for _, _, n, _ in expected)
    for r in got.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
    assert rows_of(substring_dedup.dedup_substrings(clashing, texts=False)) == expected
    assert rows_of(substring_dedup.dedup_substrings(empty, texts=False)) == []


@pytest.mark.parametrize(("window", "anchor"), [(8, 3), (5, 5)])
def test_substring_dedup_branching(spark, window, anchor):
    """Few words and many documents: most paths of the graph branch."""
    rng = np.random.default_rng(window)
    rows = [(int(k), " ".join(rng.choice(list("abc"), rng.integers(0, 60))), "en", "s") for k in rng.permutation(80)]
    got = substring_dedup.dedup_substrings(as_rows(spark, rows), window, anchor, texts=False)
    assert rows_of(got) == brute_dedup(rows, window)


def library(text):
    t = bpe.tokenizer(bpe.VOCABULARY)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_bpe_is_the_librarys(awkward, clashing, empty):
    def expected():
        for i, t, *_ in awkward_rows():
            ids, text = library(t)
            yield i, np.array(ids, "<u4").tobytes(), text

    wanted = sorted(expected(), key=repr)
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(awkward).collect()]
    assert sorted(got, key=repr) == wanted
    blocks = bpe.decode(bpe.encode(clashing, block_bytes=10_000))
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in blocks.collect()), key=repr) == wanted
    assert rows_of(bpe.digests(empty)) == []


def test_decode_leaves_out_unknown_ids(spark):
    rows = spark.createDataFrame([(1, np.array([518, 99_999, 49407], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode(rows).orderBy("doc_id").collect()] == ["the</w> <|endoftext|>", ""]


def test_token_counts(awkward, clashing, empty):
    wanted = sorted(((i, len((t or "").encode()), n := len(library(t)[0]), n > 2048) for i, t, *_ in awkward_rows()), key=repr)
    assert rows_of(token_counts.token_counts(awkward)) == wanted
    assert rows_of(token_counts.token_counts(clashing)) == wanted
    assert rows_of(token_counts.token_counts(empty)) == []


def test_counts_at_every_prefix(spark):
    text = "Internationalization isn't naïve: 日本 costs 1,234.50€ … <|endoftext|>x"
    docs = as_rows(spark, [(1, text, "en", "a")])
    tables = token_counts.prefix_counts(docs, every=True)
    asked = tables.select("*", F.explode(F.sequence(F.lit(-1), F.lit(len(text) + 1))).alias("position"))
    for r in asked.select("position", token_counts.count_at(F.col("position")).alias("n")).collect():
        assert r.n == len(library(text[: max(0, r.position)])[0]), text[: r.position]
    row = tables.select(token_counts.bytes_within(4).alias("b"), token_counts.words_within(4).alias("w"), token_counts.bytes_within(0).alias("none")).first()
    words = text.split(" ")
    fits = max(k for k in range(len(words) + 1) if len(library(" ".join(words[:k]))[0]) <= 4)
    assert row.w == fits and row.b == len(" ".join(words[:fits]).encode()) and row.none == 0


def test_counts_of_every_prefix_of_awkward_texts(awkward):
    short = awkward.where("length(text) < 2000 or text is null")
    tables = token_counts.prefix_counts(short, every=True).select("doc_id", "n_tokens", "char_tokens")
    wanted = []
    for i, t, *_ in awkward_rows():
        if len(t or "") < 2000:
            counts = [len(library((t or "")[:k])[0]) for k in range(len(t or "") + 1)]
            wanted.append((i, counts[-1], counts))
    assert rows_of(tables) == sorted(wanted, key=repr)


def test_prefix_counts_of_random_words():
    c = token_counts.counter(token_counts.VOCABULARY)
    rng = np.random.default_rng(0)
    letters = list("aabceeéghillnoorsttuüß'.-0!日")
    for _ in range(300):
        word = "".join(rng.choice(letters, rng.integers(1, 14)))
        assert c.words[word.encode()] == len(library(word)[0]), word
    assert len(c.words) <= token_counts.KEPT


def test_counts_inside_words():
    """Every prefix of a word against the library: contractions, other spaces, specials, letters outside NFC or that grow when lowered."""
    c = token_counts.counter(token_counts.VOCABULARY)
    rng = np.random.default_rng(1)
    letters = [*"aabceéghillnoorstTuüß'.-0!日本İΣ", "'re", "'LL", "\u3000", "\xa0", "\x1c", "e\u0301", "<|endoftext|>", "<|end", "한", "🙂"]
    for k in range(150):
        word = "".join(rng.choice(letters[: 29 if k % 2 else None], rng.integers(1, 12)))
        assert c.inside(word) == [len(library(word[:n])[0]) for n in range(len(word) + 1)], word


def test_truncated_inside_words(spark):
    rng = np.random.default_rng(2)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = [pick("日本語的一是在人有我他這中大来上国", 400), pick("ABCDEFGHabcdefgh0123456789+/", 500), "two words  then " + pick("abcdefghij", 300) + " end", "fits here ", "", None]
    docs = as_rows(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    tables = token_counts.prefix_counts(docs).join(docs.select("doc_id", "text"), "doc_id")
    for budget in (0, 1, 7, 50):
        for r in token_counts.truncated(tables, budget).collect():
            text = r.text or ""
            fits = max(k for k in range(len(text) + 1) if (not k or not text[k - 1].isspace()) and len(library(text[:k])[0]) <= budget)
            assert (r.kept_text, r.kept_bytes, r.kept_tokens) == (None if r.text is None else text[:fits], len(text[:fits].encode()), len(library(text[:fits])[0]))
            assert r.kept_bytes > 0 or not text or budget < 2
    nulls = token_counts.truncated(tables, F.lit(None)).select("kept_text", "kept_bytes", "kept_tokens")
    assert {tuple(r) for r in nulls.collect()} == {(None, None, None)}


def brute_near(rows, size, percent):
    sets = []
    for i, t, *_ in rows:
        w = [x.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for x in split_words(t)]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and rows[x][0] is not None and rows[y][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = defaultdict(lambda: float("inf"))
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    out = [(i, len(sets[k]), None, True) if i is None else (i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, *_) in enumerate(rows)]
    return sorted(out, key=repr)


def test_near_duplicates(awkward, clashing, empty):
    expected = brute_near(awkward_rows(), 4, 80)
    assert rows_of(minhash.near_duplicates(awkward, shingle=4)) == expected
    assert rows_of(minhash.near_duplicates(clashing, shingle=4)) == expected
    assert rows_of(minhash.near_duplicates(empty)) == []


def test_near_duplicates_of_a_spread_group(spark):
    """Copies edited more and more: only some pairs reach the threshold, and chains link the rest."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(900)]
    base = [words[k] for k in rng.integers(0, 900, 150)]
    rows = []
    for k in range(120):
        own = list(base)
        for at in rng.choice(150, rng.integers(0, 14), replace=False):
            own[at] = words[rng.integers(0, 900)]
        rows.append((int(k), " ".join(own), "en", "a"))
    got = minhash.near_duplicates(as_rows(spark, rows), shingle=4)
    assert rows_of(got) == brute_near(rows, 4, 80)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for n in (1, 3, 60, 1000):
        assert (sketch(pool[:n], 128) != 0).all()
    close = [np.mean(sketch(np.unique(x[:900]), 128) == sketch(np.unique(x[100:]), 128)) for x in rng.integers(0, 2**63, (60, 1000), dtype=np.uint64)]
    assert abs(np.mean(close) - 0.8) < 0.02 and np.std(close) < 0.05


def test_components_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(3, 2), (2, 1), (7, 7)], "a long, b long")
    roots = dict(minhash.components(links).collect())
    assert {roots[k] for k in range(10, 41)} == {10} and roots[3] == roots[2] == roots[1] == 1 and roots[7] == 7


def brute_quality(text):
    w = [x.decode() for x in split_words(text)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {p for k, g in enumerate(windows) if n[g] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base(awkward, clashing, empty):
    def wanted():
        for i, t, *_ in awkward_rows():
            base = brute_quality(t)
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            yield i, *base, failed, not failed

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = sorted(wanted(), key=repr)
    assert rows_of(quality.quality(awkward).select(columns)) == expected
    assert rows_of(quality.quality(clashing).select(columns)) == expected
    assert rows_of(quality.quality(empty)) == []


def test_quality_line_frequency(spark):
    """A line in more documents of a host than the limit goes; rows of one doc_id count once, and so do equal texts without one; another host's lines don't count."""
    own = lambda k: " ".join(chr(97 + k % 26) * 3 + chr(97 + k // 26) + chr(97 + j) for j in range(12))
    boiler = "All rights reserved 2024 and so on and so forth for ever and ever"
    rows = [(k, f"{own(k)}\n{boiler}", "en", "h") for k in range(6)]
    rows += [(50, f"{boiler}\nALL rights  reserved 1999 and so on and so forth for ever and ever", "en", "h")]
    rows += [(60, f"{own(60)}\n{boiler}", "en", "other")] + [(70, own(70) + "\n" + own(71), "en", "h") for k in range(9)] + [(None, own(80), "en", "h") for k in range(9)]
    rows += [(90 + k, own(90), "en", "h") for k in range(6)]
    got = {r.doc_id: r for r in quality.quality(as_rows(spark, rows), line_limit=5).collect()}
    assert got[0].n_removed == 14 and got[0].kept
    assert got[50].n_removed == 28 and not got[50].kept
    assert got[60].n_removed == 0 and got[70].n_removed == 0 and got[70].kept and got[None].kept
    assert all(got[90 + k].n_removed == 12 and not got[90 + k].kept for k in range(6))  # copies are documents


def test_quality_texts_without_frequent_lines(spark, awkward, empty):
    own = lambda k: " ".join(chr(97 + k % 26) * 3 + chr(97 + j) for j in range(12))
    boiler, again = "All rights reserved 2024, you & me", "  ALL rights  reserved 1999, you & me\t"
    rows = [(k, f"{own(k)}\n\n{boiler}\n é {chr(97 + k)}x\n{again}\n", "en", "h") for k in range(6)]
    # one doc_id and text under two hosts, a repeated row, a null host, nulls
    rows += [(3, rows[3][1], "en", "other"), rows[4], (60, rows[5][1], "en", None), (None, rows[0][1], "en", "h"), (61, None, "en", "h")]
    got = quality.quality(as_rows(spark, rows), line_limit=5, texts=True)
    cleaned = lambda k: f"{own(k)}\n\n é {chr(97 + k)}x\n"
    wanted = [(k, cleaned(k), [boiler, again], 14) for k in [0, 1, 2, 3, 4, 4, 5]]
    wanted += [(3, rows[3][1], [], 0), (60, rows[5][1], [], 0), (None, cleaned(0), [boiler, again], 14), (61, None, [], 0)]
    assert rows_of(got.select("doc_id", "kept_text", "removed_lines", "n_removed")) == sorted(wanted, key=repr)
    assert rows_of(got.drop("kept_text", "removed_lines")) == rows_of(quality.quality(as_rows(spark, rows), line_limit=5))
    plain = quality.quality(awkward, texts=True)
    assert rows_of(plain.select("doc_id", "kept_text")) == sorted(((i, t) for i, t, *_ in awkward_rows()), key=repr)
    assert rows_of(plain.drop("kept_text", "removed_lines")) == rows_of(quality.quality(awkward))
    assert rows_of(quality.quality(empty, texts=True)) == []


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    return tuple(sum(k == x for *_, k in found) for x in ("assign", "access", "hex")) + (hashlib.sha256(base.encode()).hexdigest(),)


def test_many_secrets_of_one_text(spark):
    text = "é🙂 " + " ".join(f"{k:030x} password=abcdef{k}" for k in range(3000)) + " end"
    table = as_rows(spark, [(1, text, "en", "a")])
    assert [r[:-1] for r in rows_of(secrets.secret_digests(table))] == [(1, *brute_secrets(text))]
    assert secrets.redacted(table).first().text == "é🙂 " + " ".join(["[hex] [assign]"] * 3000) + " end"


def test_secrets(awkward, clashing, empty):
    expected = sorted(((i, *brute_secrets(t)) for i, t, *_ in awkward_rows()), key=repr)
    for table in (awkward, clashing):
        got = secrets.secret_digests(table)
        assert rows_of(got.drop("spans")) == expected
    more = "".join(r.spans for r in got.where("doc_id = 16").collect())
    assert all(k in more for k in ("assign", "github", "private_key", "slack"))
    assert rows_of(secrets.secret_digests(empty)) == []
    kept = secrets.find_secrets(clashing)
    assert kept.columns.count("secrets") == 1 and set(clashing.columns) == set(kept.columns)


def test_redaction(spark):
    rows = [(1, "a password=abcdef123 b", "en", "a"), (2, "🙂 token: 'deadbeefdeadbeefdeadbeef00' z", "en", "a"), (3, "clean", "en", "a"), (4, None, "en", "a")]
    got = {r.doc_id: r.text for r in secrets.redacted(as_rows(spark, rows)).collect()}
    assert got == {1: "a [assign] b", 2: "🙂 [assign]' z", 3: "clean", 4: None}


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xyz+") == frozenset({frozenset({"abc", "bcd"}), frozenset({"xyz"})})
    assert secrets.trigram_query("[0-9a-f]{24,}") == frozenset({frozenset()})
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    assert frozenset() not in secrets.trigram_query(secrets.RULES[0].pattern)


def test_native_operators_run_no_python(awkward):
    from veilspan.llm import mixing

    for df in (secrets.secret_digests(awkward), mixing.mixture(awkward)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
