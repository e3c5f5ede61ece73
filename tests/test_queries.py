"""Every registered query of the language against DuckDB, and the driver's entry with and without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from winnow.operators import oracles, queries, surface, surface_oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


QUERIES = {**queries.queries(), **surface.queries()}
SQL = {**oracles.oracle_sql(), **surface_oracles.oracle_sql()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_each_query_has_sql_and_the_entry_runs(spark, data):
    assert not set(queries.queries()) & set(surface.queries())
    assert set(SQL) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_library_stands_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    env = os.environ | {"PYTHONPATH": str(copy)}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env=env, check=True)
    assert said.stdout.split() == [str(len(QUERIES))] * 2
    # What is left passes its own tests, but for this one.
    rest = subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "-k", "language or options or long_queries or agrees_with_sql and flagship"], cwd=copy, capture_output=True, text=True, env=env, check=False)
    assert rest.returncode == 0, rest.stdout[-2000:]


def test_nothing_else_imports_the_llm_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "winnow")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "winnow.llm" not in f.read(), n


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from winnow import ConfigError
    from winnow.sources.scratch import shared_dir

    session = lambda master, folder: Fake(conf=Fake(get=lambda key, default=None: folder), sparkContext=Fake(master=master, getConf=lambda: Fake(get=lambda key: None)))
    assert shared_dir(session("spark://host:7077", "s3a://bucket/scratch/")) == "s3a://bucket/scratch" and shared_dir(session("local[4]", None)).startswith("file:")
    with pytest.raises(ConfigError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session("spark://host:7077", None))
