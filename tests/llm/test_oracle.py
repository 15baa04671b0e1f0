"""The registered text queries against their SQL in DuckDB, on a small table."""

import duckdb
import pytest

from scenfold.llm.oracle import ORACLE
from scenfold.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
LARGER = {"op13_collocations": "/root/testdata/sf0.01"}  # phrases must occur a hundred times


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    folder = LARGER.get(name, SF_DIR)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = con.execute(ORACLE[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    expected = sorted(tuple(r[order.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == expected
    assert expected


NATIVE = ("op2_quality_rules", "op7_imatch", "op8_sharding", "op10_mixing")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
