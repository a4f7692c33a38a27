"""Every catalogue query against its SQL counterpart on another engine."""

import duckdb
import pytest

import __spark_entry__ as contract
from govlake.plans.catalog import QUERIES
from govlake.plans.oracle import ORACLE_SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def _rows(columns, names, rows):
    order = [names.index(c) for c in columns]
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    columns = sorted(result.columns)
    assert columns == sorted(names)
    got = _rows(columns, result.columns, [tuple(r) for r in result.collect()])
    assert got == _rows(columns, names, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(contract.queries()) >= set(QUERIES)
    assert set(contract.oracle_sql()) >= set(ORACLE_SQL)


def test_entry(spark):
    assert contract.entry(spark).columns == ["user_id", "requests", "tokens_in", "tokens_out", "usd_spent"]


# Times each query reads a table of the sample, in the plan that is run last.
SCANS = {"allowed_models": 1, "allowlist_violations": 1, "corpus_scrub": 1, "usage_by_user": 1, "budget_replay": 2, "window_counts": 1}


@pytest.mark.parametrize("name", list(SCANS))
def test_scans_per_query(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert sum(f"{sf_dir.removeprefix('/')}/" in line for line in plan.split("\n") if "FileScan" in line) == SCANS[name]
