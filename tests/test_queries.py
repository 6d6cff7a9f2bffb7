from __future__ import annotations

import pytest

import __spark_entry__
from inkline.plans.queries import QUERIES, SQL
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, sf, name):
    assert difference(spark, QUERIES[name], SQL[name], sf) == ({}, {})


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["conv_id", "turn", "edits", "cer"]
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
