"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from civitext import plans
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == []


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row.task == "hate_speech" and 0 <= row.f1_macro <= 1
