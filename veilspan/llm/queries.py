"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, token_counts
from .common import read
from .conversations import repaired
from .language_id import document_languages, page_languages
from .minhash import near_duplicates
from .mixing import mixture
from .phrases import collocations
from .quality import quality
from .secrets import secret_digests
from .substring_dedup import dedup_substrings
from .toxicity import toxicity
from .vafile import search_exact


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"), window=50, texts=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), limit=2048)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("passages")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(read(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), least=10, subsumed=50, most=2000)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_exact(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "language_id_pages": language_id_pages,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_ann": op7_ann,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_exact_topk": op12_exact_topk,
    "op13_conversation_repair": op13_conversation_repair,
}

_OP1 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
grams AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT DISTINCT doc_id, i FROM grams JOIN firsts USING (g) WHERE lo < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS k FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = [
    ("assign", f"(?:{_ANY_CASE})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(m, '{pattern}', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    ("private_key", "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", "true"),
]


def _secret_sql(rank: int, kind: str, pattern: str, keep: str) -> str:
    pattern = pattern.replace("'", "''")
    keep = keep.format(pattern=pattern)
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL))
) WHERE {keep}"""


_OP10 = (
    "WITH found AS ("
    + " UNION ALL ".join(_secret_sql(k, *x) for k, x in enumerate(_SECRETS))
    + """),
text AS (SELECT doc_id, rank, s, kind || ':' || s::BIGINT || ':' || e::BIGINT AS t FROM found),
agg AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
  string_agg(t, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(t, ',' ORDER BY s, rank) AS spans FROM text GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN agg USING (doc_id)"""
)

_OP8 = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w),
full_line AS (SELECT doc_id, source, line, array_to_string(list_filter(string_split_regex(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS normal FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY doc_id),
frequent AS (SELECT source, normal FROM full_line GROUP BY ALL HAVING count(DISTINCT doc_id) > 100),
gone AS (SELECT doc_id, sum(len(string_split(f.normal, ' ')))::BIGINT AS n FROM full_line f JOIN frequent q ON f.normal = q.normal AND f.source IS NOT DISTINCT FROM q.source GROUP BY doc_id),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < 10 OR n_words - n_removed < 0.3 * n_words)) AS kept FROM judged
"""

_OP11 = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece),
f1 AS (SELECT lang, x, count(*)::BIGINT AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*)::BIGINT AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*)::BIGINT AS f FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, 1 AS k, c.f AS a, p.f AS l, q.f AS r FROM f2 c JOIN f1 p ON p.lang = c.lang AND p.x = c.x JOIN f1 q ON q.lang = c.lang AND q.x = c.y
  WHERE c.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.x = c.x AND t.y = c.y AND 100 * t.f >= 50 * c.f) AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND t.y = c.x AND t.z = c.y AND 100 * t.f >= 50 * c.f)
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 1, c.f, p.f, q.f FROM f3 c JOIN f1 p ON p.lang = c.lang AND p.x = c.x JOIN f2 q ON q.lang = c.lang AND q.x = c.y AND q.y = c.z
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 2, c.f, p.f, q.f FROM f3 c JOIN f2 p ON p.lang = c.lang AND p.x = c.x AND p.y = c.y JOIN f1 q ON q.lang = c.lang AND q.x = c.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

_OP12 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

ORACLE_SQL = {
    "op12_exact_topk": _OP12,
    "op11_phrase_mining": _OP11,
    "op8_quality_rules": _OP8,
    "op10_secret_scan": _OP10,
    "op6_minhash_near_dedup": _OP6,
    "op1_substring_dedup": _OP1,
}
