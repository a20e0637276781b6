"""Every registered query that has an oracle against it, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import table

from partyframe.plans import ORACLES, QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, small, name):
    assert table(QUERIES[name](spark, small)) == table(duck.sql(ORACLES[name]))


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
