"""The contract's queries against their SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from chronotally import queries as own

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
NAMES = ["value_hour_by_type", "count_minute_none", "rollup_all_masks", "rollup_custom_masks", "orders_by_status", "filter_and_or_not", "late_bump_store", "compacted", "compacted_in_place", "stored_scan", "streamed_ingest", "reduction_by_mask", "tag_texts", "purge_one", "filter_single_children", "date_steps", "configured_by_xml", "auto_precision_second", "validate_split", "xml_roundtrip", "event_ids_capped", "corr_complement", "corr_intersect", "date_between", "auto_precision_day", "mask_functions", "time_functions", "describe_source"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = own.queries()[name](spark, DIR), db.sql(own.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == sorted(map(repr, want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["bucket_ms", "n", "v", "mn", "mx", "event_type"]
    assert set(own.queries()) <= set(entry.queries()) and set(own.oracle_sql()) <= set(own.queries())
