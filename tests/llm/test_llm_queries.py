"""Registered queries against their SQL on the smallest tables, and without SQL for their columns."""

import oracle
import pytest

from retrievo.llm import queries  # noqa: F401
from retrievo.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    outcome = oracle.compare(spark, oracle.connect(sf_dir), name, sf_dir, QUERIES[name], SQL[name])
    assert outcome.startswith("ok"), outcome
