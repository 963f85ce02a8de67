"""Every query with a SQL twin gives DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_same_result_on_other_partition_counts(spark, data):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, catalog.QUERIES[q](spark, data).collect())) for q in ("q01_explore_page", "q13_dictionary_build", "q42_components", "q46_bin_pick_thin")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry(spark, data):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["section", "key", "value", "n"] and found.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
