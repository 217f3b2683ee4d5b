"""The driver contract, and every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SMALL
from oracle_check import compare, connect

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry_builds_an_index(spark):
    index = contract.entry(spark)
    assert index.count() == 15 and {"id", "distance_km", "coverage", "status_counts", "bbox"} <= set(index.columns)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["j7_localities", "p28_trip_routes"])
def test_places_a_turn_apart_equal_their_sql(spark, tmp_path, name):
    """The first position of this trip is as far from two suppliers, but for the last digit."""
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 560::BIGINT AS user_id
        FROM range(1, 53) r(i) UNION ALL SELECT i + 1, TIMESTAMP '2024-01-01' + to_seconds(i), 560 FROM range(53, 66) r(i))
        TO '{tmp_path}/events.parquet'""")
    duckdb.execute(f"""COPY (SELECT k::BIGINT AS s_suppkey, 'Supplier#' || lpad(k::VARCHAR, 9, '0') AS s_name, 20 AS s_nationkey, 500.0::DOUBLE AS s_acctbal
        FROM (VALUES (56), (36056)) r(k)) TO '{tmp_path}/supplier.parquet'""")
    duckdb.execute(f"COPY (FROM '{SMALL}/part.parquet') TO '{tmp_path}/part.parquet'")
    folder = str(tmp_path)
    assert compare(spark, connect(folder), name, QUERIES[name], ORACLES[name], folder) is None
