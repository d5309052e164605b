"""Every registered query runs; those with SQL equal DuckDB on the same files."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return repr(round(float(value), 9) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, FOLDER)
    got = _rows(result.columns, [tuple(r) for r in result.collect()])
    if name not in contract.oracle_sql():
        assert got
        return
    answer = duck.execute(contract.oracle_sql()[name])
    names = [column[0] for column in answer.description]
    assert sorted(result.columns) == sorted(names)
    assert got == _rows(names, answer.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "embedding_id", "similarity", "rank"]


def test_entry_without_a_library_of_the_text_operators():
    """With a package missing the text queries are not there, the others are."""
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as c\n"
            "assert 'similar_topk' in c.queries() and not any(n.startswith('op') or n == 'pipeline' for n in c.queries())\n"
            "assert set(c.oracle_sql()) <= set(c.queries())")
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(contract.__file__)),
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
