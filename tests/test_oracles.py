"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")

from vistaquad.plans.registry import ORACLES, QUERIES  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql_or_a_plain_version():
    """The others are held against plain versions: test_whole_jobs, test_detection, test_homographies."""
    assert set(QUERIES) - set(ORACLES) <= {"q29_refine", "q30_search", "q33_detect", "q34_homography", "q35_ransac", "q55_contour_tree"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
