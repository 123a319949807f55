"""All queries of the engine against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from relata import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    if name in queries.ORACLE:
        want = oracle.execute(queries.ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in want.fetchall()])


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["restrict_and_or"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    plan = queries.QUERIES["fold_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_image_of_a_group_stays_rows(spark):
    """A region's customers are no array, which would be carried on each of its rows."""
    plan = queries.QUERIES["image_in_program"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan and "inline" not in plan
