"""The entry points, and queries against DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lectern import sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fixed = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else str(x) if hasattr(x, "isoformat") else x
    return sorted((tuple(map(fixed, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == columns
    want = plain(tuple(r[named.index(c)] for c in columns) for r in result.fetchall())
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_functions(spark):
    sql.register(spark)
    page = "<table><tr><th>Term</th><th>Call</th></tr><tr><td>Fall  2025</td><td>001/1</td></tr></table>"
    assert [r["cells"] for r in spark.sql(f"select * from html_tables('{page}')").collect()] == [["Term", "Call"], ["Fall 2025", "001/1"]]
    assert [tuple(r) for r in spark.sql("select * from occurrences('Aba aba', 'ABA')").collect()] == [(0, 3), (4, 7)]
    assert spark.sql("select least_courses('coms w3134 or (math un1201 and apma e2000)')").first()[0] == 1
