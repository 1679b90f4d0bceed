"""Registered queries against DuckDB on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from keystrata import catalogue

from .conftest import ROOT, TESTDATA

FOLDER = TESTDATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() == 1500
    names = set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("missing", ["keystrata.llm", "corpus_pipeline", "xxhash", "tokenizers"])
def test_the_rest_works_without_optional_parts(missing):
    """Neither an absent part nor an absent library of it takes the other queries away."""
    code = f"import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    names = said.stdout.split()
    assert set(catalogue.queries()) <= set(names), said.stderr
