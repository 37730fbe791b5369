"""Every registered query against DuckDB: same columns, types and rows."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from fleetops.plans.oracles import ORACLES
from fleetops.plans.queries import QUERIES

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(testdata):
    connection = duckdb.connect()
    for path in glob.glob(f"{testdata}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows(records):
    def plain(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else value

    return Counter(tuple(plain(v) for v in record) for record in records)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, duck, testdata):
    df = QUERIES[name](spark, testdata)
    columns = sorted(df.columns)
    result = duck.sql(ORACLES[name])
    types = dict(zip(result.columns, [str(t) for t in result.types]))
    assert columns == sorted(result.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = ", ".join(f'"{c}"' for c in columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    want = rows(duck.sql(f"SELECT {order} FROM ({ORACLES[name]}) q").fetchall())
    assert sum(got.values()) > 0
    assert got == want
