"""Every query with an oracle gives the oracle's rows."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) if value != int(value) else int(value)
    return str(value) if value is not None and not isinstance(value, int | bool) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = rows(df.columns, df.collect())
    duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in duck.description]
    theirs = rows(names, duck.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(mine) == len(theirs)
    assert mine == theirs
    assert mine, "an empty result proves nothing"
