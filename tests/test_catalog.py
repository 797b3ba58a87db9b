"""The registered queries: complete pairs, agreement with SQL on the smallest tables, and the shape of their plans."""

import math
import os
import re

import pytest

import __spark_entry__ as contract
import framewright
from framewright.plans import catalog

ROOT = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return con


def _rows(columns, rows):
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(row[c]) for c in columns) for row in rows), key=repr)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = _rows(columns, [dict(zip(names, row)) for row in result.fetchall()])
    got = _rows(columns, df.collect())
    assert len(got) == len(want)
    assert all(all(map(_same, g, w)) for g, w in zip(got, want))


@needs_tables
def test_entry(spark):
    assert contract.entry(spark).count() == 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_one_shuffle_orders_a_topic(spark):
    for name in ("ratio_average", "drift_monitor", "queue_depths", "running_by_topic", "breaker_log", "batches_by_timer"):
        assert len(re.findall(r"Exchange hashpartitioning", _plan(catalog.QUERIES[name](spark, ROOT)))) == 1, name


@needs_tables
def test_scans_read_only_what_is_used(spark):
    plan = _plan(catalog.QUERIES["ratio_average"](spark, ROOT))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in schema and "user_id" not in schema
    plan = _plan(catalog.QUERIES["active_dictionary_lookup"](spark, ROOT))
    assert "n_chars" not in plan


@needs_tables
def test_filters_reach_the_scan(spark):
    plan = _plan(catalog.QUERIES["unsettled_frames"](spark, ROOT))
    assert "EqualTo(l_returnflag,R)" in plan


def test_the_public_names_exist():
    assert all(hasattr(framewright, name) for name in framewright.__all__)
