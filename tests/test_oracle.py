"""Every registered query against its SQL in DuckDB, on the smallest tables, and its plan."""

import re

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry_module

from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = entry_module.SMOKE_DIR
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows):
    return sorted((tuple(0.0 if v == 0 else v for v in row) for row in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name, monkeypatch):
    """The plans of what a query checkpoints while it is defined count like its own."""
    plans, checkpoint = [], DataFrame.checkpoint

    def recorded(self, *args, **options):
        plans.append(physical_plan(self))
        return checkpoint(self, *args, **options)

    monkeypatch.setattr(DataFrame, "checkpoint", recorded)
    df = entry_module.queries()[name](spark, SF_DIR)
    for plan in [*plans, physical_plan(df)]:
        assert len(re.findall("FileScan.*lineitem", plan)) <= 1
        assert not re.search("NestedLoop|Cartesian|Python", plan)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    result = duck.execute(entry_module.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    expected = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    assert canonical(got) == canonical(expected)
    assert got


def test_entry_is_stable(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["Scenario", "t", "Value"]
    assert df.count() == 28
