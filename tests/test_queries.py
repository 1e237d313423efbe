"""Registered queries against their SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from notewell.plans import route

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(name for name in entry.oracle_sql() if not re.match(r"op\d+_", name))  # those are tested with their package
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    cursor = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_oracle_has_a_query_and_sql_binds(sql):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    for text in oracles.values():
        sql.execute("EXPLAIN " + text)


def test_whole_job_of_sorting_and_query_building(spark):
    queries, orders = entry.queries(), spark.read.parquet(f"{SF}/orders.parquet").count()
    ranks = {}
    for r in queries["sort_ranks"](spark, SF).collect():
        ranks.setdefault(r["mode"], []).append(r["rank"])
    assert set(ranks) == {"priority", "recent", "budget", "urgency"}
    assert all(sorted(found) == list(range(1, orders + 1)) for found in ranks.values())
    assert queries["build_query_all"](spark, SF).count() == orders
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert queries["product_candidates_all"](spark, SF).agg({"query_id": "max"}).first()[0] >= vectors


def test_router_is_trained_with_the_defaults(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(route, "train_router", lambda *a, **b: asked.append((a[1:], b)))
    entry.queries()["route_ml"](spark, SF)
    assert asked == [((), {})]


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
