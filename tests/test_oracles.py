"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, con, name):
    rows, wrong = compare(spark, con, name, SF)
    assert not wrong
    assert rows > 0


def test_names_agree():
    assert set(ORACLES) == set(registered())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
