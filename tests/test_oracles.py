"""Every query with SQL against DuckDB over the same rows."""

from collections import Counter

import duckdb
import pytest

from deploylens import queries as Q

SF = "/root/testdata/sf0.001"
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, duck, name):
    found = Q.queries()[name](spark, SF)
    names = sorted(found.columns)
    rows = Counter(tuple(r[c] for c in names) for r in found.collect())
    assert rows
    sql = Q.oracle_sql().get(name)
    if sql is None:
        return
    kinds = {r[0]: TYPES[r[1]] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert kinds == dict(found.dtypes)
    wanted = duck.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert rows == Counter(wanted)
