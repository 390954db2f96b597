"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from claimlake.plans import queries

TABLES = os.environ.get("CLAIMLAKE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in (row[i] for i in order)) for row in rows)


def test_every_sql_has_its_query():
    assert set(queries.ORACLE) <= set(queries.QUERIES) and queries.FLAGSHIP in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, db, name):
    got = queries.QUERIES[name](spark, TABLES)
    want = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_without_sql_runs(spark, name):
    queries.QUERIES[name](spark, TABLES).count()


def test_flagship_plan_reads_two_columns(spark, capsys):
    queries.QUERIES["glob_filter"](spark, TABLES).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<path:string>" in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["did_you_mean", "did_you_mean_osa", "similar_paths_all", "similar_symbols"])
def test_suggestions_broadcast_no_side_that_grows(spark, name):
    assert "Broadcast" not in queries.QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


def test_path_verdicts_scan_pages_once_and_suggest_only_where_read(spark):
    plan = queries.QUERIES["verdict_paths"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "levenshtein" not in plan


def test_config_verdicts_suggest_only_where_read(spark):
    plan = queries.QUERIES["verdict_config"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Broadcast" not in plan
