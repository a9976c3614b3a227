"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import pytest
from oracle import connect, same

from kinmer.plans import files, general, mimicry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**mimicry.QUERIES, **general.QUERIES, **files.QUERIES}
ORACLES = {**mimicry.ORACLES, **general.ORACLES, **files.ORACLES}


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    same(QUERIES[name](spark, SF_DIR), db, ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "Human_dominant_fraction" in df.columns


def test_fisher_query_has_a_p_value_for_each_full_row(spark):
    for r in QUERIES["fisher_test"](spark, SF_DIR).collect():
        known = None not in (r.cases_with, r.controls_with)
        assert (r.p_value is not None) == known and (not known or 0 < r.p_value <= 1)
