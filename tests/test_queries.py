"""Every registered query next to its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lapstream.plans.catalog import ORACLES as SQLS
from lapstream.plans.catalog import QUERIES
from tests.sidebyside import differences, oracle

# Fits need more laps than the smallest tables have.
LARGER = "/root/testdata/sf0.01"
ON_FITS = ("m12_backtest", "o4_advice_refresh")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQLS[name]) == []


@pytest.mark.parametrize("name", ON_FITS)
def test_query_on_fits(spark, name):
    found = QUERIES[name](spark, LARGER).cache()
    assert differences(found, oracle(LARGER), SQLS[name]) == []
    assert not found.isEmpty()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQLS) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
