"""Queries of the subpackage that SQL can express, against their twins on the smallest tables."""

from __future__ import annotations

import pytest
from lorebook.llm.queries import QUERIES, SQL
from oracle import compare, duck


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    message, _, _ = compare(spark, duck(sf), name, QUERIES[name], SQL[name], sf)
    assert message is None


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES
