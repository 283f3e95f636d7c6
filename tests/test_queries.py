"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__
from reportloom.plans import REGISTRY

from .compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry_has_rows_and_every_query_has_sql(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(REGISTRY) <= set(__spark_entry__.oracle_sql()) and set(REGISTRY) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, name):
    fn, sql = REGISTRY[name]
    assert compare(spark, duck, FOLDER, fn, sql) is None
