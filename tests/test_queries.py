"""Every query of the library against its oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

from spanloom.plans import registry
from tests.oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name: str) -> None:
    agree(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_has_a_name_of_its_own() -> None:
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
