"""Every registered query of the sequence engine against its SQL twin on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__
from tidewise.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, db, name):
    got, twin = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(twin.columns)
    order = [list(twin.columns).index(c) for c in columns]
    kinds = dict(got.dtypes)
    assert [TYPES[kinds[c]] for c in columns] == [str(twin.types[k]) for k in order]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[k] for k in order) for r in twin.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_type", "n"]


@pytest.mark.parametrize("name", ["f_take", "j_with_latest_from", "r_accumulate_sum", "t_debounce", "w_buffer_overlap"])
def test_plans_shuffle_once_and_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan and "SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["f_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan.split("PushedFilters: ")[1].split("]")[0] and "props" not in plan


def test_whole_sort_has_every_row_in_order(spark):
    got = QUERIES["l_sorted"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" in plan
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count() and [r["place"] for r in rows] == list(range(1, len(rows) + 1))


def test_without_the_corpus_package(spark, monkeypatch):
    """Entry, queries and twins where the optional subpackage is gone."""
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("tidewise.llm") else find(name, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
    assert __spark_entry__.entry(spark).columns == ["event_type", "n"]
