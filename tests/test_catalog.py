"""Every registered query of the library against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from veilspan.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        assert rows == sorted(str(x) for x in found.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, timeout=120)


def test_neighbours_of_whole_texts(spark, tmp_path):
    """Chains after the 400th character and one on it are found whole."""
    import re

    texts = ["x" * 395 + " Alexander Smith said, and Mary  Ann Lee too. " + "y " * 300 + "Old Town", "Ann Bo\nCy " * 200, "none", None, "é🙂 Ada Lovelace"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = []
    for k, text in enumerate(texts):
        chains = []
        for m in re.finditer("[A-Z][a-z]+", text or ""):
            if chains and m.start() - chains[-1][-1].end() <= 2:
                chains[-1].append(m)
            else:
                chains.append([m])
        wanted += [(k, "".join(m[0] for m in c), c[0].start(), c[-1].end(), len(c)) for c in chains]
    got = QUERIES["merge_neighbours"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert any(x[2] < 400 < x[3] for x in wanted)


def test_detection_is_computed_once(spark):
    """Each pattern is matched once for a row, whatever is done with the entities afterwards."""
    from veilspan.functions.spans import PIECE
    from veilspan.operators.recognizers import DEFAULTS

    pieces = f"(?s).{{1,{PIECE}}}"  # what cuts a text for its rewriting is no recognizer's pattern, and stands there once
    all_, five = sum(len(r.patterns) for r in DEFAULTS), 6
    for name, most in (("detect_email", 1), ("detect_summary", all_), ("batch_stats", all_), ("resolve_conflicts", five), ("refined", five), ("redact_text", five), ("pseudonyms", five), ("type_filter", all_), ("confidence_filter", five)):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") - plan.count(pieces) <= most and plan.count(pieces) <= 1, name


@pytest.mark.parametrize("name", ["detect_summary", "batch_stats"])
def test_types_beyond_the_sql(spark, tmp_path, name):
    """A digest may hold what reads as an identity number; types that the SQL doesn't know are not counted."""
    texts = ["digest ab123456199001011234cd", "E12345678 and G1234567", "123-45-6789", "https://x.org/a", "a@example.org, 10.0.0.1 and 13812345678", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    found = con.sql(ORACLE_SQL[name])
    assert sorted(map(tuple, got.collect())) == sorted(found.select(*(f'"{c}"' for c in got.columns)).fetchall())
