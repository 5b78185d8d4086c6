"""Every query that has SQL gives what DuckDB gives; the others run and give rows."""

import math

import duckdb
import pytest

from semilattice.operators import query
from semilattice.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v
    return sorted(columns), sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        got = con.execute(registry.ORACLES[name])
        assert tidy(df.columns, rows) == tidy([d[0] for d in got.description], got.fetchall())
    else:
        assert rows


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.ORACLES) <= set(e.oracle_sql()) and set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 20


def test_scope_and_fields_reach_the_scan(spark):
    from semilattice.sources.oplog import table

    plan = table(spark, SF, "customer").where("c_nationkey = 3").select("c_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,3)]" in plan and "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan


def test_places_of_more_rows_than_a_sort_samples(spark):
    rows = spark.range(0, 200_000, 1, 7).selectExpr("id", "cast(id as string) as row_id", "cast(id * 7919 % 1009 as string) as name")
    got = {r.id: r.place for r in query.with_places(query.in_order(rows, "name"), "place").select("id", "place").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(200_000), key=lambda i: (str(i * 7919 % 1009), str(i))), 1)}
