"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest
from oracle import compare, duck

from lorebook.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_matches_sql(spark, con, sf, name):
    message, _, _ = compare(spark, con, name, registry.queries()[name], registry.oracle_sql().get(name), sf)
    assert message is None


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
