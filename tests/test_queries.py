"""Every traffic query against its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tollgate.plans import adapters, catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


def plain(df):
    def text(x):
        if pd.isna(x):
            return None
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else repr(round(x, 6))
        return str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(text, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"toy_sweep", "toy_report", "trips_sweep"}))
def test_other_queries_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_bounding_box_numbers_and_broadcasts_nothing(spark):
    plan = catalogue.queries()["bounding_box"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Window" not in plan and "Broadcast" not in plan


def test_customers_of_trips_are_not_broadcast(spark):
    plan = adapters.trips(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
