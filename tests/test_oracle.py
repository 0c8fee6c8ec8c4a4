"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os

import duckdb
import pytest

from oracle_compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="test tables not present")
def test_all_queries_match_oracle(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sqls = E.oracle_sql()
    bad = []
    for name, fn in E.queries().items():
        if name not in sqls:
            continue
        df = fn(spark, SF)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        if sorted(df.columns) != sorted(ocols) or digest(df.columns, rows)[0] != digest(ocols, orows)[0]:
            bad.append(name)
    assert bad == []


def test_entry_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["project_id", "path", "rank", "is_key", "score", "health", "color", "n_findings"]
    assert df.count() > 0


def test_every_query_has_oracle_sql():
    from codeatlas.plans.oracle import oracle_sql
    from codeatlas.plans.queries import QUERIES
    assert set(QUERIES) == set(oracle_sql())
