"""Every registered query against its SQL, and the contract of the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0) if x != int(x) else str(int(x))
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_chunk_html_leaves_references_that_break_off(spark, tmp_path):
    page = "<p>cut&&&amp short &ltb &amp;lt; &amp;&amp; caf&eacute; &#65; x&nbsp;y &copy;&middot;&#39;&quot;</p>"
    spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r[c] for c in ("page_id", "seq", "start_word", "end_word", "text")) for r in catalog.queries()["chunk_html"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == c.sql(f"SELECT page_id, seq, start_word, end_word, text FROM ({catalog.oracle_sql()['chunk_html']})").fetchall()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "bm25"] and df.count() > 0


def test_map_points(spark):
    out = catalog.queries()["svd_map_points"](spark, SMALL).collect()
    assert len(out) == 500 and len({r["eta"] for r in out}) == 1


def test_the_rest_stands_without_the_llm_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
