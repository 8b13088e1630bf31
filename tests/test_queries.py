"""Every registered query against its SQL, and the guard round the llm subpackage."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quire.queries import QUERIES, SQL

from .conftest import ROOT, SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name, tmp_path):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/q")
    ours, theirs = duck.sql(f"SELECT * FROM '{tmp_path}/q/*.parquet'"), duck.sql(SQL[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = [sorted(repr(plain(r)) for r in x.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()) for x in (ours, theirs)]
    assert rows[0] == rows[1]


def test_drop_packages_where_words_are_empty(spark, tmp_path):
    texts = ["   Erin elle", "     ", "漢字 漢字 漢字 字", "a  b", " a b", "  a b", "a a a a", "a b a c", "a", "", " ", "a ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = dict(QUERIES["drop_packages"](spark, str(tmp_path)).select("doc_id", "tex").collect())
    assert ours == dict(c.sql(f"SELECT doc_id, tex FROM ({SQL['drop_packages']})").fetchall())
    assert ours[0] == "  \\usepackage[x]{, , } % why\n   Erin elle" and ours[6] == "a a a a" and len(ours) == len(texts) - 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_everything_else_works_without_the_llm_subpackage(tmp_path):
    for f in ("quire", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{f}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/quire/llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == f"{len(QUERIES)} []"
