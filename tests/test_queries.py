import glob
import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not there")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda index: names[index])
    return sorted(names), Counter(tuple(row[index] for index in order) for row in values)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    frame = queries()[name](spark, FOLDER)
    cursor = database.execute(oracle_sql()[name])
    assert rows(frame.columns, frame.collect()) == rows([item[0] for item in cursor.description], cursor.fetchall())


def test_entry_and_names(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
