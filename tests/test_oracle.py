"""Every query with a SQL twin against DuckDB on the smallest tables; the others run and keep their columns."""

from __future__ import annotations

import pytest
from oracle import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, name):
    assert compare(spark, name, SF) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


@pytest.mark.parametrize(
    "name,columns",
    [
        ("p1_found", [("icao", "string"), ("start_us", "bigint"), ("end_us", "bigint")]),
        ("p2_found", [("seq", "bigint")]),
        ("p3_found", [("seq", "bigint"), ("field", "string")]),
        ("p4_found", [("station_id", "string"), ("slot_us", "bigint")]),
        ("p5_found", [("station_id", "string"), ("period_us", "bigint")]),
        ("p6_found", [("icao", "string"), ("start_slot", "bigint"), ("end_slot", "bigint")]),
        ("p7_found", [("seq", "bigint"), ("airfield_id", "bigint")]),
    ],
)
def test_columns(spark, name, columns):
    assert entry.queries()[name](spark, SF).dtypes == columns
